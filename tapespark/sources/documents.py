"""Captions, transcripts, announcements and pages to tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.folds import sweep

# Named character references and what they stand for; numbered ones are computed.
_NAMED = {
    "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0", "copy": "\u00a9", "reg": "\u00ae", "deg": "\u00b0", "middot": "\u00b7", "laquo": "\u00ab", "raquo": "\u00bb", "euro": "\u20ac",
    "pound": "\u00a3", "ndash": "\u2013", "mdash": "\u2014", "lsquo": "\u2018", "rsquo": "\u2019", "ldquo": "\u201c", "rdquo": "\u201d", "bull": "\u2022", "hellip": "\u2026", "trade": "\u2122", "times": "\u00d7",
}


def unescape(text: Column) -> Column:
    """Character references undone: the named ones above, and any by its decimal or hexadecimal number."""

    def numbered(part: Column, k: Column) -> Column:
        digits = F.regexp_extract(part, "^([0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});", 1)
        code = F.when(F.lower(F.left(digits, F.lit(1))) == "x", F.conv(F.substring(digits, 2, 6), 16, 10)).otherwise(digits).try_cast("long")
        good = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        rest = F.substring(part, F.length(digits) + 2, F.length(part))
        return F.when(k == 0, part).when((digits != "") & good, F.concat(char, rest)).otherwise(F.concat(F.lit("&#"), part))

    plain = F.when(F.contains(text, F.lit("&#")), F.array_join(F.transform(F.split(text, "&#"), numbered), "")).otherwise(text)
    for name, char in _NAMED.items():
        plain = F.replace(plain, F.lit(f"&{name};"), F.lit(char))
    return F.replace(plain, F.lit("&amp;"), F.lit("&"))


def _seconds(stamp: Column) -> Column:
    """Seconds of hours, minutes and seconds between colons, of which the leading ones may be missing; null if a part is no number."""
    parts = F.transform(F.split(F.replace(stamp, F.lit(","), F.lit(".")), ":"), lambda x: F.when(x.rlike(r"^[0-9]+(\.[0-9]*)?$"), x.try_cast("double")))
    return F.when(F.size(parts).between(2, 3), F.aggregate(parts, F.lit(0.0), lambda total, x: total * 60 + x))


def segments(cues: DataFrame, key: str) -> DataFrame:
    """Cues (key, block, cue: a line of times and the lines under it) to segments: key, seq, start, end, text.

    Tags go, character references are undone, and a line that equals one of the last three lines kept goes, as roll-up captions
    repeat them. Blocks without a line of times are no cues. The lines of a file are walked in order; nothing is gathered.
    """
    lines = F.split(F.regexp_replace(F.col("cue"), r"\r\n?", "\n"), "\n")
    which = F.try_element_at(F.filter(lines, lambda x: F.contains(x, F.lit("-->"))), F.lit(1))
    sides = F.split(which, "-->")
    first = lambda k: F.get(F.split(F.trim(F.get(sides, F.lit(k))), r"\s+"), F.lit(0))
    rows = cues.withColumn("lines", lines).where(F.exists("lines", lambda x: F.contains(x, F.lit("-->"))))
    rows = rows.select(key, "block", _seconds(first(0)).alias("start"), _seconds(first(1)).alias("end"), F.slice("lines", F.array_position("lines", which) + 1, F.size("lines")).alias("lines")).where("start IS NOT NULL AND end IS NOT NULL")
    bare = lambda x: F.trim(F.regexp_replace(unescape(F.regexp_replace(x, "<[^>]*>", "")), r"[\s\u00a0]+", " "))
    rows = rows.select(key, "block", "start", "end", F.posexplode(F.transform("lines", bare)).alias("place", "text")).where("text <> ''")

    def fresh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = None, []
        for batch in batches:
            kept = []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(5).to_pylist(), strict=True):
                if k != now:
                    now, last = k, []
                kept.append(text not in last)
                if kept[-1]:
                    last = [*last[-2:], text]
            yield batch.filter(pa.array(kept, pa.bool_()))

    kept = sweep(rows, [key], ["block", "place"], fresh, rows.schema)
    out = kept.groupBy(key, "block", "start", "end").agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("lines"))
    seq = (F.row_number().over(Window.partitionBy(key).orderBy("block")) - 1).cast("long")
    return out.select(key, seq.alias("seq"), "start", "end", F.array_join(F.transform("lines", lambda x: x["text"]), " ").alias("text"))


def cues(files: DataFrame, key: str, text: str) -> DataFrame:
    """Caption files (VTT or SRT) to segments: what stands between blank lines is a cue if it has a line of times."""
    body = F.regexp_replace(F.col(text), r"\r\n?", "\n")
    return segments(files.select(key, F.posexplode(F.split(body, r"\n[ \t]*\n")).alias("block", "cue")), key)


def announced(titles: DataFrame, title: str, patterns: dict[str, str]) -> DataFrame:
    """A row per token of the titles that match: the other columns, kind, token. The last pattern that matches gives the kind;
    its first group is a list between commas, "and" or "&"."""
    kind, found = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, pattern in patterns.items():
        hit = F.col(title).rlike(pattern)
        kind, found = F.when(hit, F.lit(name)).otherwise(kind), F.when(hit, F.regexp_extract(title, pattern, 1)).otherwise(found)
    rest = [c for c in titles.columns if c != title]
    rows = titles.select(*rest, kind.alias("kind"), F.explode(F.split(found, r"\s*,\s*|\s+and\s+|\s*&\s*")).alias("token"))
    return rows.withColumn("token", F.trim("token")).where("token <> ''")


def paragraphs(files: DataFrame, key: str, text: str) -> DataFrame:
    """Untimed text to segments: blocks between blank lines, white space collapsed."""
    parts = F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda p: F.trim(F.regexp_replace(p, r"\s+", " "))), lambda p: p != "")
    return files.select(key, F.posexplode(parts).alias("seq", "text"))


def transcript_json(files: DataFrame, key: str, text: str) -> DataFrame:
    """JSON transcripts to segments."""
    items = F.from_json(text, "array<struct<start:double,end:double,text:string>>")
    return files.select(key, F.posexplode(items).alias("seq", "x")).select(key, "seq", "x.start", "x.end", "x.text")


def page_snapshots(pages: DataFrame, most_links: int = 5000) -> DataFrame:
    """url, snapshot id by content, title, language, distinct absolute links (capped as a feature), text, word count."""
    html = F.col("html")
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", " "), r"(?s)<[^>]*>", " ")
    text = F.trim(F.regexp_replace(unescape(bare), r"\s+", " "))
    links = F.slice(F.array_distinct(F.regexp_extract_all(html, F.lit(r"(?i)href=[\"'](https?://[^\"'#\s]+)"), F.lit(1))), 1, most_links)
    return pages.select(
        "url",
        F.substring(F.sha2(html, 256), 1, 16).alias("snapshot"),
        F.nullif(F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit("")).alias("title"),
        F.nullif(F.regexp_extract(html, r"(?i)<html[^>]*\slang=[\"']?([A-Za-z-]+)", 1), F.lit("")).alias("lang"),
        links.alias("links"),
        text.alias("text"),
        F.size(F.filter(F.split(text, " "), lambda w: w != "")).cast("long").alias("words"),
    )
