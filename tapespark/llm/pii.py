"""Personal data by regular expressions, checksums and context words; DataFrame functions only.

A pattern's matches come from ``regexp_extract_all`` and the texts between them from ``split``; their lengths give the code
point positions. Patterns are possessive forms of the plain ones: they find the same matches without stack growth or
quadratic retries on long runs. Candidates that fail their check (ranges, Luhn, mod 97, number of digits) are dropped, the
rest get the score of their kind, plus ``CONTEXT`` if a context word stands in the ``WINDOW`` characters before or after the
match; those below ``LEAST`` are dropped. Windows reach over one match of the same kind on each side. Email, ip, card and phone
numbers with a plus pass on their own; IBANs, also in groups of four, and plain phone numbers, which need a context word, are
added where they overlap none of those.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._rows import fresh, named

WINDOW, LEAST, CONTEXT = 40, 0.5, 0.35
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "local_phone")
# The patterns of each kind (possessive where that changes no match), scores and context words.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9_])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9_])",
    "local_phone": r"(?<![A-Za-z0-9_])[0-9]{3}[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![A-Za-z0-9_])",
}
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.6, "phone": 0.5, "iban": 0.6, "local_phone": 0.2}
WORDS = {
    "email": "email|e-mail|mail|contact",
    "ip": "ip|host|server|address",
    "card": "card|visa|mastercard|amex|credit|debit",
    "phone": "phone|tel|telephone|call|fax|mobile|cell",
    "iban": "iban|account|bank",
    "local_phone": "phone|tel|telephone|call|fax|mobile|cell",
}
#: What a text must contain for a pattern to be tried.
_NEEDS = {"email": "@", "phone": "+"}
_BLOCK = 256


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` applied to a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _add(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)


def _prefix_sums(steps: Column) -> Column:
    """Sum of the steps before each element, in two levels so that many matches in a text stay cheap."""

    def within(s: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / _BLOCK).cast("int")), lambda b: _add(F.slice(s, b * _BLOCK + 1, _BLOCK)))
        before = let(blocks, lambda t: F.transform(t, lambda _, i: _add(F.slice(t, F.lit(1), i))))
        return let(before, lambda t: F.transform(s, lambda _, i: F.element_at(t, F.floor(i / _BLOCK).cast("int") + 1) + _add(F.slice(s, F.floor(i / _BLOCK).cast("int") * _BLOCK + 1, i % _BLOCK))))

    return let(steps, within)


_SPAN = "array<struct<kind:string,start:bigint,end:bigint,match:string,around:string>>"


def spans(text: Column, kind: str, pattern: str, matches: Column) -> Column:
    """Start and end (code points, end exclusive), match and surrounding characters of the given matches of a pattern."""
    n = F.size(matches)

    def located(pieces: Column) -> Column:
        steps = F.zip_with(F.slice(pieces, F.lit(1), n), matches, lambda p, m: (F.length(p) + F.length(m)).cast("long"))
        none = F.array(F.lit(""))
        rows = F.arrays_zip(
            _prefix_sums(steps).alias("at"),
            F.slice(pieces, F.lit(1), n).alias("piece"),
            F.slice(pieces, F.lit(2), n).alias("rest"),
            matches.alias("match"),
            F.concat(none, F.slice(matches, F.lit(1), n - 1)).alias("last"),
            F.concat(F.slice(matches, F.lit(2), n - 1), none).alias("next"),
        )
        return F.transform(
            rows,
            lambda r: F.struct(
                F.lit(kind).alias("kind"),
                (r["at"] + F.length(r["piece"])).alias("start"),
                (r["at"] + F.length(r["piece"]) + F.length(r["match"])).alias("end"),
                r["match"].alias("match"),
                F.concat(F.right(F.concat(r["last"], F.right(r["piece"], F.lit(WINDOW))), F.lit(WINDOW)), F.lit(" "), F.left(F.concat(F.left(r["rest"], F.lit(WINDOW)), r["next"]), F.lit(WINDOW))).alias("around"),
            ),
        )

    return F.when(n > 0, let(F.split(text, pattern, -1), located)).otherwise(F.array().cast(_SPAN))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True if a string of digits has a right Luhn check digit."""

    def add(total: Column, i: Column) -> Column:
        d = F.ascii(F.substring(digits, i, F.lit(1))) - 48
        return total + F.when((F.length(digits) - i) % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod97(code: Column) -> Column:
    """True if an account code leaves 1 by ISO 7064 mod 97-10."""
    moved = F.concat(F.substring(code, F.lit(5), F.length(code)), F.left(code, F.lit(4)))

    def add(rest: Column, c: Column) -> Column:
        v = F.ascii(c)
        return F.when(v < 58, (rest * 10 + v - 48) % 97).otherwise((rest * 100 + v - 55) % 97)

    return F.aggregate(F.split(moved, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(add(a, c))) == 1


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: p.rlike("^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"))
    if kind == "card":
        return let(_digits(match), lambda d: F.length(d).between(16, 19) & luhn(d))
    if kind == "phone":
        return F.length(_digits(match)).between(8, 15)
    if kind == "iban":
        return let(F.regexp_replace(match, " ", ""), lambda c: F.length(c).between(15, 34) & mod97(c))
    return F.lit(True)


def _score(kind: str, around: Column) -> Column:
    near = around.rlike(f"(?i)(^|[^A-Za-z])({WORDS[kind]})([^A-Za-z]|$)")
    return F.lit(SCORES[kind]) + F.when(near, CONTEXT).otherwise(0.0)


def find_pii(docs: DataFrame, keep: list[str], column: str = "text", names: tuple[str, str] | None = None) -> DataFrame:
    """The ``keep`` columns, then two arrays of (kind, start, end, score) by kind, then start, as ``names`` (``__base`` and
    ``__found``, with underscores added where a kept column has that name).

    The first has the kinds that pass on their own, the second those and the added ones. A null or empty text has none. Rows
    are independent, so repeated rows and ids are all kept; there is no shuffle. Further columns pass through if kept.
    """
    first, second = names or fresh(keep, "base", "found")
    text = F.col("text")
    rows = docs.select(*(c.alias(f"c{k}") for k, c in enumerate(named(*keep))), F.coalesce(named(column)[0].cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("digit", text.rlike("[0-9]"))
    for kind in KINDS:
        tried = text.contains(_NEEDS[kind]) if kind in _NEEDS else F.lit(True)
        tried = tried & F.col("digit") if kind != "email" else tried
        rows = rows.withColumn(kind, F.when(tried, F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))).otherwise(F.array().cast("array<string>")))
    for kind in KINDS:
        some = F.filter(spans(text, kind, PATTERNS[kind], F.col(kind)), lambda s: _valid(kind, s["match"]))
        scored = F.transform(some, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), _score(kind, s["around"]).alias("score")))
        rows = rows.withColumn(kind, F.filter(scored, lambda s: s["score"] >= LEAST))
    rows = rows.withColumn("base", F.concat(*(F.col(k) for k in BASE)))
    added = F.concat(*(F.col(k) for k in KINDS if k not in BASE))
    clear = F.filter(added, lambda s: ~F.exists(F.col("base"), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return rows.select(*(F.col(f"c{k}").alias(n) for k, n in enumerate(keep)), F.col("base").alias(first), F.concat("base", clear).alias(second))


def digest(found: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, the number of spans of each base kind, the sha256 of the base spans, all spans as text, and their scores in per cent.

    Every row of ``docs`` gives a row; its further columns, whatever their names, stay out.
    """
    rows = find_pii(docs, ["doc_id"], names=("base", "found"))
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    counts = [of(k).alias(f"n_{k}") for k in BASE]
    scores = F.array_join(F.transform("found", lambda s: F.round(s["score"] * 100).cast("int").cast("string")), ",")
    return rows.select("doc_id", *counts, F.sha2(digest(F.col("base")).cast("binary"), 256).alias("base_sha256"), digest(F.col("found")).alias("spans"), scores.alias("scores"))


# The same by DuckDB: plain patterns, positions from the lengths of the pieces between matches.
_PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b",
    "local_phone": r"\b[0-9]{3}[\x20.-][0-9]{3}[\x20.-][0-9]{4}\b",
}


def _sql() -> str:
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    place = f"CAST(substr(reverse({digits}), i, 1) AS INT)"
    code = "replace(m, ' ', '')"
    ok = {
        "email": "true",
        "ip": r"len(list_filter(string_split(m, '.'), lambda p: NOT regexp_full_match(p, '0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])'))) = 0",
        "card": f"length({digits}) BETWEEN 16 AND 19 AND list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN (i % 2) = 1 THEN {place} WHEN {place} > 4 THEN 2 * {place} - 9 ELSE 2 * {place} END)) % 10 = 0",
        "phone": f"length({digits}) BETWEEN 8 AND 15",
        # the remainder goes from character to character, since the whole number has more digits than an integer
        "iban": f"length({code}) BETWEEN 15 AND 34 AND list_reduce(list_transform(string_split(substr({code}, 5) || substr({code}, 1, 4), ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN CAST(c AS INT) ELSE ascii(c) - 55 END), lambda r, x: (CASE WHEN x > 9 THEN 100 * r + x ELSE 10 * r + x END) % 97) = 1",
        "local_phone": "near",
    }
    parts = []
    for k, kind in enumerate(KINDS):
        parts.append(
            f"""SELECT doc_id, {k} AS k, '{kind}' AS kind, s, e, {round(100 * SCORES[kind])} + CASE WHEN near THEN {round(100 * CONTEXT)} ELSE 0 END AS score FROM (
  SELECT doc_id, m, before + length(piece) AS s, before + length(piece) + length(m) AS e,
    regexp_matches(right(last || right(piece, {WINDOW}), {WINDOW}) || ' ' || left(left(rest, {WINDOW}) || next, {WINDOW}), '(?i)(^|[^A-Za-z])({WORDS[kind]})([^A-Za-z]|$)') AS near
  FROM (SELECT doc_id, unnest(ms) AS m, unnest(ps[1:len(ms)]) AS piece, unnest(ps[2:len(ms) + 1]) AS rest, unnest([''] || ms[1:len(ms) - 1]) AS last, unnest(ms[2:len(ms)] || ['']) AS next,
      unnest(list_transform(range(len(ms)), lambda j: coalesce(list_sum(list_transform(ps[1:j], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:j], lambda x: length(x))), 0))) AS before
    FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_PLAIN[kind]}') AS ms, string_split_regex(coalesce(text, ''), '{_PLAIN[kind]}') AS ps FROM documents)
    WHERE len(ms) > 0)) WHERE {ok[kind]}"""
        )
    span = "kind || ':' || CAST(CAST(s AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(e AS BIGINT) AS VARCHAR)"
    return f"""WITH found AS ({" UNION ALL ".join(parts)}),
clear AS (SELECT * FROM found f WHERE k < {len(BASE)} OR NOT EXISTS (SELECT 1 FROM found b WHERE b.k < {len(BASE)} AND b.doc_id = f.doc_id AND b.s < f.e AND f.s < b.e)),
doc AS (SELECT doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
  coalesce(string_agg({span}, ',' ORDER BY k, s) FILTER (k < {len(BASE)}), '') AS base, string_agg({span}, ',' ORDER BY k, s) AS spans,
  string_agg(CAST(score AS VARCHAR), ',' ORDER BY k, s) AS scores FROM clear GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores FROM documents d LEFT JOIN doc USING (doc_id)"""


ORACLE_SQL = _sql()
