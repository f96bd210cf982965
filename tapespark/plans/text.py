"""Text, page, transcript and evidence queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import text as X
from ..operators import evidence
from ..sources import documents, feeds, tape
from ..sources.tape import DAILY, LAUNCHES, TAPE, TICKS
from .registry import Tables, query
from .tape import prints


@query("p1_price", f"WITH {TAPE} SELECT seq, round(vsol / vtok, 8) AS price, round(vsol / vtok * 1e9, 0) AS cap FROM tape")
def p1_price(t: Tables) -> DataFrame:
    s, k = F.col("vsol"), F.col("vtok")
    return prints(t).select("seq", F.round(C.price(s, k), 8).alias("price"), F.round(C.market_cap(s, k), 0).alias("cap"))


@query("p2_fee_fraction", "SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN l_discount = 0 THEN 125 / 1e4 ELSE (round(l_discount * 1e4) + CASE WHEN l_tax > 0 THEN round(l_tax * 1e4) ELSE 0 END) / 1e4 END, 8) AS fee FROM lineitem")
def p2_fee_fraction(t: Tables) -> DataFrame:
    bps = F.when(F.col("l_discount") != 0, F.round(F.col("l_discount") * 1e4))
    creator = F.when(F.col("l_tax") > 0, F.round(F.col("l_tax") * 1e4))
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(C.fee_fraction(bps, creator), 8).alias("fee"))


@query("p3_quotes", f"WITH {TAPE} SELECT seq, round(vtok * (100 / 1.0125) / (vsol + 100 / 1.0125), 9) AS bought, round(vsol * 0.5 / (vtok + 0.5) * (1 - 0.0125), 6) AS got FROM tape")
def p3_quotes(t: Tables) -> DataFrame:
    s, k, fee = F.col("vsol"), F.col("vtok"), F.lit(0.0125)
    return prints(t).select("seq", F.round(C.quote_buy(s, k, F.lit(100.0), fee), 9).alias("bought"), F.round(C.quote_sell(s, k, F.lit(0.5), fee), 6).alias("got"))


@query(
    "p4_round_trip",
    f"WITH {TAPE}, n AS (SELECT seq, vsol AS s0, vtok AS k0, lead(vsol) OVER w AS s1, lead(vtok) OVER w AS k1 FROM tape WINDOW w AS (PARTITION BY mint ORDER BY recv, seq)), q AS (SELECT *, k0 * (10 / 1.0125) / (s0 + 10 / 1.0125) AS got FROM n WHERE s1 IS NOT NULL) SELECT seq, round(s1 * got / (k1 + got) * (1 - 0.0125) - 10, 8) AS net FROM q",
)
def p4_round_trip(t: Tables) -> DataFrame:
    w = Window.partitionBy("mint").orderBy("recv", "seq")
    n = prints(t).withColumn("s1", F.lead("vsol").over(w)).withColumn("k1", F.lead("vtok").over(w)).where("s1 IS NOT NULL")
    return n.select("seq", F.round(C.round_trip(F.col("vsol"), F.col("vtok"), F.col("s1"), F.col("k1"), F.lit(10.0), F.lit(0.0125)), 8).alias("net"))


@query("p5_log_impact", f"WITH {TAPE} SELECT seq, round(2 * ln(vsol / CASE WHEN buy THEN vsol - sol ELSE vsol + sol END), 8) AS impact FROM tape")
def p5_log_impact(t: Tables) -> DataFrame:
    return prints(t).select("seq", F.round(C.log_impact(F.col("buy"), F.col("vsol"), F.col("sol")), 8).alias("impact"))


@query("p6_mid_after", f"WITH {TAPE} SELECT seq, round(greatest(vsol + CASE WHEN buy THEN sol ELSE -sol END + 5, 0) / greatest(vtok + CASE WHEN buy THEN -tok ELSE tok END, 1e-12), 8) AS mid FROM tape")
def p6_mid_after(t: Tables) -> DataFrame:
    b = F.col("buy")
    return prints(t).select("seq", F.round(C.mid_after(F.col("vtok"), F.col("vsol"), F.when(b, -F.col("tok")).otherwise(F.col("tok")), F.when(b, F.col("sol")).otherwise(-F.col("sol")), F.lit(5.0)), 8).alias("mid"))


@query("p7_trusted", f"WITH {TAPE} SELECT seq FROM tape WHERE abs(vsol - sol - 30) < 0.01 AND discount > 0.05")
def p7_trusted(t: Tables) -> DataFrame:
    return prints(t).where(C.trusted(F.col("vsol"), F.col("sol")) & (F.col("discount") > 0.05)).select("seq")


_SHOWN = "CASE event_id % 6 WHEN 0 THEN '$' || CAST(round(value, 1) AS VARCHAR) || 'K' WHEN 1 THEN '1,2' || CAST(event_id % 100 AS VARCHAR) WHEN 2 THEN CAST(event_id % 100 AS VARCHAR) || '%' WHEN 3 THEN 'n/a' WHEN 4 THEN '1.5m' ELSE '' END"


@query(
    "p8_display_number",
    f"WITH s AS (SELECT event_id, {_SHOWN.replace('CAST(round(value, 1) AS VARCHAR)', 'CAST(event_id % 50 AS VARCHAR)')} AS shown FROM events) SELECT event_id, round(CAST(nullif(replace(regexp_extract(shown, '^[$]?([0-9][0-9,.]*)[kKmMbB%]?$', 1), ',', ''), '') AS DOUBLE) * CASE lower(right(shown, 1)) WHEN 'k' THEN 1e3 WHEN 'm' THEN 1e6 ELSE 1 END, 4) AS number FROM s",
)
def p8_display_number(t: Tables) -> DataFrame:
    n = F.col("event_id")
    text = lambda x: (n % x).cast("string")
    shown = F.when(n % 6 == 0, F.concat(F.lit("$"), text(50), F.lit("K"))).when(n % 6 == 1, F.concat(F.lit("1,2"), text(100))).when(n % 6 == 2, F.concat(text(100), F.lit("%"))).when(n % 6 == 3, "n/a").when(n % 6 == 4, "1.5m").otherwise("")
    return t("events").select("event_id", F.round(X.display_number(shown), 4).alias("number"))


_HELD = "CASE event_type WHEN 'error' THEN 'after a while' WHEN 'view' THEN CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) || 'd ' || CAST(event_id % 24 AS VARCHAR) || 'h' WHEN 'click' THEN CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) || 'mo' WHEN 'signup' THEN CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) || 'ms' ELSE CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) || 'm ' || CAST(CAST(floor(value * 60) AS BIGINT) % 60 AS VARCHAR) || 's' END"


@query(
    "p9_display_duration",
    f"""WITH s AS (SELECT event_id, {_HELD} AS shown FROM events), n AS (SELECT event_id, shown, regexp_extract_all(shown, '([0-9]+)(ms|mo|[smhdwy])', 1) AS a, regexp_extract_all(shown, '([0-9]+)(ms|mo|[smhdwy])', 2) AS u FROM s)
SELECT event_id, CASE WHEN len(a) > 0 AND trim(regexp_replace(shown, '([0-9]+)(ms|mo|[smhdwy])', '', 'g')) = '' THEN list_sum(list_transform(range(1, len(a) + 1), lambda i: CAST(a[i] AS DOUBLE) * CASE u[i] WHEN 'ms' THEN 0.001::DOUBLE WHEN 's' THEN 1 WHEN 'm' THEN 60 WHEN 'h' THEN 3600 WHEN 'd' THEN 86400 WHEN 'mo' THEN 2592000 END)) END AS seconds FROM n""",
)
def p9_display_duration(t: Tables) -> DataFrame:
    """Durations as shown, in five forms by the kind of event, of which one is none."""
    whole = lambda c: F.floor(c).cast("string")
    v, kind = F.col("value"), F.col("event_type")
    shown = F.when(kind == "error", "after a while").when(kind == "view", F.concat(whole(v), F.lit("d "), (F.col("event_id") % 24).cast("string"), F.lit("h"))).when(kind == "click", F.concat(whole(v), F.lit("mo"))).when(kind == "signup", F.concat(whole(v), F.lit("ms"))).otherwise(F.concat(whole(v), F.lit("m "), (F.floor(v * 60) % 60).cast("string"), F.lit("s")))
    return t("events").select("event_id", X.display_duration(shown).alias("seconds"))


@query("p10_normal_text", "SELECT item_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS normal FROM benchmark")
def p10_normal_text(t: Tables) -> DataFrame:
    return t("benchmark").select("item_id", X.normal(F.col("text")).alias("normal"))


@query("p11_name_keys", "SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS key, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def p11_name_keys(t: Tables) -> DataFrame:
    return t("part").select("p_partkey", X.name_key(F.col("p_name")).alias("key"), X.slug(F.col("p_name")).alias("slug"))


@query("p12_url_keys", "SELECT page_id, regexp_replace(regexp_replace(lower(regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1)), '://www\\.', '://') || regexp_extract(regexp_replace(url, '#.*$', ''), '^[A-Za-z]+://[^/?]*(.*)$', 1), '/+$', '') AS key, regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)), '^www\\.', '') AS domain FROM pages")
def p12_url_keys(t: Tables) -> DataFrame:
    return t("pages").select("page_id", X.url_key(F.col("url")).alias("key"), X.domain(F.col("url")).alias("domain"))


@query("p13_stable_ids", "SELECT o_orderkey, 'ord_' || substr(sha256(CAST(o_orderkey AS VARCHAR) || chr(31) || coalesce(o_orderstatus, '') || chr(31) || ''), 1, 16) AS id FROM orders")
def p13_stable_ids(t: Tables) -> DataFrame:
    return t("orders").select("o_orderkey", X.stable_id("ord", F.col("o_orderkey"), F.col("o_orderstatus"), F.lit(None)).alias("id"))


_KINDS = {"money": "card|price|\\$", "rights": "rights reserved|licensed", "insult": "stupid|trash|pathetic"}


@query("p14_categories", " UNION ALL ".join(f"SELECT doc_id, '{k}' AS category, regexp_extract(text, '(?i)({p})', 1) AS matched FROM documents WHERE regexp_matches(text, '(?i)({p})')" for k, p in _KINDS.items()))
def p14_categories(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", F.explode(X.categories(F.col("text"), _KINDS)).alias("x")).select("doc_id", "x.category", "x.matched")


@query("p15_name_flags", "SELECT p_partkey, regexp_matches(lower(p_name), 'red|blue|green') AS colour, regexp_matches(lower(p_type), 'steel|brass|tin') AS metal FROM part")
def p15_name_flags(t: Tables) -> DataFrame:
    return t("part").select("p_partkey", F.lower("p_name").rlike("red|blue|green").alias("colour"), F.lower("p_type").rlike("steel|brass|tin").alias("metal"))


@query("p16_keywords", "SELECT DISTINCT p_partkey, w AS word FROM (SELECT p_partkey, unnest(regexp_split_to_array(lower(p_name), '[^a-z0-9]+')) AS w FROM part) WHERE length(w) >= 4 AND NOT regexp_full_match(w, '[0-9]+') AND w NOT IN ('part', 'item')")
def p16_keywords(t: Tables) -> DataFrame:
    return t("part").select("p_partkey", F.explode(X.keywords(F.col("p_name"), ["part", "item"])).alias("word"))


@query(
    "p17_link_kinds",
    r"""WITH l AS (SELECT page_id, unnest(list_distinct([url] || regexp_extract_all(html, '(?i)href=["'']([^"'']+)', 1))) AS link FROM pages)
SELECT page_id, link, CASE WHEN regexp_matches(lower(link), '(x|twitter)\.com/[^/]+/status/') THEN 'post' WHEN regexp_matches(lower(link), '(x|twitter)\.com/i/communities/') THEN 'community' WHEN regexp_matches(lower(link), '(x|twitter)\.com/[a-z0-9_]+/?$') THEN 'profile' WHEN link = '' THEN 'none' ELSE 'other' END AS kind,
 nullif(lower(regexp_extract(link, '(?i)(?:x|twitter)\.com/([A-Za-z0-9_]{1,15})/status/', 1)), '') AS author FROM l""",
)
def p17_link_kinds(t: Tables) -> DataFrame:
    """The kind of a page's own address and of every link in it, with the author where it is a post."""
    links = F.array_distinct(F.concat(F.array("url"), F.regexp_extract_all("html", F.lit(r"(?i)href=[\"']([^\"']+)"), F.lit(1))))
    rows = t("pages").select("page_id", F.explode(links).alias("link"))
    return rows.select("page_id", "link", X.link_kind(F.col("link")).alias("kind"), X.post_author(F.col("link")).alias("author"))


@query("p18_symbol_base", "SELECT p_partkey, upper(replace(p_brand, '#', '')) AS base, CASE p_partkey % 3 WHEN 0 THEN 1000 WHEN 1 THEN 1000000 ELSE 1 END AS multiple FROM part")
def p18_symbol_base(t: Tables) -> DataFrame:
    brand = F.upper(F.replace("p_brand", F.lit("#"), F.lit("")))
    symbol = F.concat(F.when(F.col("p_partkey") % 3 == 0, "1000").when(F.col("p_partkey") % 3 == 1, "1M").otherwise(""), brand)
    return t("part").select("p_partkey", X.symbol_base(symbol).alias("x")).select("p_partkey", "x.base", "x.multiple")


@query("p19_slippage_tier", "SELECT o_custkey, CASE WHEN avg(o_totalprice) >= 200000 THEN 0.0005 WHEN avg(o_totalprice) >= 150000 THEN 0.001 ELSE 0.003 END::DOUBLE AS slip FROM orders GROUP BY o_custkey")
def p19_slippage_tier(t: Tables) -> DataFrame:
    return t("orders").groupBy("o_custkey").agg(C.slippage_tier(F.avg("o_totalprice"), [(200_000, 0.0005), (150_000, 0.001)], 0.003).alias("slip"))


@query("p20_split_label", f"WITH {TAPE} SELECT seq, CASE WHEN recv < 788918400000000 THEN 'train' WHEN recv < 852076800000000 THEN 'validation' WHEN recv < 883612800000000 THEN 'holdout' ELSE 'forward' END AS split FROM tape")
def p20_split_label(t: Tables) -> DataFrame:
    bounds = [(788_918_400_000_000, "train"), (852_076_800_000_000, "validation"), (883_612_800_000_000, "holdout")]
    return prints(t).select("seq", C.split_label(F.col("recv"), bounds, "forward").alias("split"))


@query("p21_error_class", "SELECT doc_id, CASE WHEN text IS NOT NULL THEN CASE WHEN contains(lower(text), 'rights reserved') OR contains(lower(text), 'license') OR contains(lower(text), 'sign in') THEN 'blocked' ELSE 'error' END END AS class FROM documents")
def p21_error_class(t: Tables) -> DataFrame:
    """Answers that only say that one may not read on, by marks in their text."""
    return t("documents").select("doc_id", X.error_class(F.col("text"), ["rights reserved", "license", "sign in"]).alias("class"))


@query("p22_signed_log", "SELECT event_id, round(sign(value - 50) * ln(1 + abs(value - 50)), 9) AS x, greatest(least(value, 80), 20) AS clipped FROM events")
def p22_signed_log(t: Tables) -> DataFrame:
    v = F.col("value") - 50
    return t("events").select("event_id", F.round(C.signed_log1p(v), 9).alias("x"), C.clip(F.col("value"), 20.0, 80.0).alias("clipped"))


_POSTS = """posts AS (SELECT o.launch, e.event_id AS status, e.user_id AS author, e.t AS posted, e.event_type, e.props, o.born, min(e.t) OVER (PARTITION BY e.user_id) AS joined
  FROM launches o LEFT JOIN (SELECT event_id, key AS user_id, t - 946684800000000 AS t, event_type, props FROM ticks) e ON e.event_id = o.launch // 3)"""


@query(
    "p23_post_features",
    f"""WITH {LAUNCHES}, {TICKS}, {_POSTS} SELECT launch, status IS NULL AS post_missing, round((born - posted) / 6e7, 3) AS post_age_min, round((born - joined) / 8.64e10, 6) AS account_age_d, event_type = 'click' AS is_reply, event_type = 'view' AS is_quote, contains(props, '7') AS has_media,
 length(props) AS text_len, regexp_matches(props, '[0-9]{{2,}}') AS mentions_number, CASE WHEN status IS NOT NULL THEN row_number() OVER (PARTITION BY status ORDER BY born, launch) END AS rank_for_post FROM posts""",
)
def p23_post_features(t: Tables) -> DataFrame:
    """Features of the post that a launch cites: ages at the launch, kind, text, and the how-manieth launch for the post.

    Events are thirty years later than launches, so posts are moved by as much.
    """
    ticks = tape.ticks(t("events")).withColumn("t", F.col("t") - 946_684_800_000_000)
    cited = tape.launches(t("orders")).select("launch", "born", F.floor(F.col("launch") / 3).alias("event_id"))
    posts = cited.join(ticks.withColumn("status", F.col("event_id")), "event_id", "left")
    seen = posts.where("status IS NOT NULL").groupBy("key").agg(F.min("t").alias("first"))
    posts = posts.join(seen, "key", "left")
    rank = F.when(F.col("status").isNotNull(), F.row_number().over(Window.partitionBy("status").orderBy("born", "launch")))
    return posts.select(
        "launch", F.col("status").isNull().alias("post_missing"), F.round((F.col("born") - F.col("t")) / 6e7, 3).alias("post_age_min"), F.round((F.col("born") - F.col("first")) / 8.64e10, 6).alias("account_age_d"), (F.col("event_type") == "click").alias("is_reply"), (F.col("event_type") == "view").alias("is_quote"),
        F.contains(F.col("props"), F.lit("7")).alias("has_media"), F.length("props").cast("long").alias("text_len"), F.col("props").rlike("[0-9]{2,}").alias("mentions_number"), rank.cast("long").alias("rank_for_post"),
    )


@query("p24_hms", "SELECT doc_id, printf('%02d:%02d:%02d', n_chars // 3600, (n_chars // 60) % 60, n_chars % 60) AS hms FROM documents")
def p24_hms(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", C.hms(F.col("n_chars")).alias("hms"))


@query("p25_bands", f"WITH {TAPE} SELECT seq FROM tape WHERE sol BETWEEN 10000 AND 50000 AND tok >= 10 AND discount BETWEEN 0.02 AND 0.06 AND buy")
def p25_bands(t: Tables) -> DataFrame:
    return prints(t).where(F.col("sol").between(10_000, 50_000) & (F.col("tok") >= 10) & F.col("discount").between(0.02, 0.06) & F.col("buy")).select("seq")


@query("p26_taker_fill", f"WITH {TAPE} SELECT seq, round((least(30, tok) * CASE WHEN buy THEN vsol * 1.001 ELSE vsol END + (30 - least(30, tok)) * CASE WHEN buy THEN vsol * 1.001 + (vsol * 1.001 - vsol) ELSE vsol - (vsol * 1.001 - vsol) END) / 30, 6) AS fill FROM tape")
def p26_taker_fill(t: Tables) -> DataFrame:
    bid = F.col("vsol")
    return prints(t).select("seq", F.round(C.taker_fill(bid, bid * 1.001, F.col("tok"), F.col("tok"), F.col("buy"), F.lit(30.0)), 6).alias("fill"))


@query(
    "p27_book_vwap",
    "WITH l AS (SELECT l_orderkey, l_extendedprice / l_quantity AS price, l_quantity AS size, coalesce(sum(l_extendedprice) OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice / l_quantity, l_quantity, l_linenumber, l_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM lineitem), u AS (SELECT l_orderkey, greatest(least(50000 - before, price * size), 0) AS used, price FROM l) SELECT l_orderkey, round(CASE WHEN sum(used) >= 50000 - 1e-6 THEN 50000 / sum(used / price) END, 8) AS vwap FROM u GROUP BY l_orderkey",
)
def p27_book_vwap(t: Tables) -> DataFrame:
    level = F.struct((F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("size"), "l_linenumber", "l_partkey")
    return t("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(level)).alias("levels")).select("l_orderkey", F.round(C.book_vwap(F.col("levels"), 50_000), 8).alias("vwap"))


@query("p28_link_flags", "SELECT page_id, contains(lower(html), 't.me/') AS telegram, regexp_matches(lower(html), '(x|twitter)\\.com/') AS x, contains(lower(html), 'href=') AS website FROM pages")
def p28_link_flags(t: Tables) -> DataFrame:
    h = F.lower("html")
    return t("pages").select("page_id", F.contains(h, F.lit("t.me/")).alias("telegram"), h.rlike(r"(x|twitter)\.com/").alias("x"), F.contains(h, F.lit("href=")).alias("website"))


@query("s15_paragraphs", "SELECT doc_id, count(*) AS segments, max(length(p)) AS longest FROM (SELECT doc_id, trim(regexp_replace(unnest(string_split(text, chr(10))), '\\s+', ' ', 'g')) AS p FROM documents) WHERE p <> '' GROUP BY doc_id")
def s15_paragraphs(t: Tables) -> DataFrame:
    blank = t("documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return documents.paragraphs(blank, "doc_id", "text").groupBy("doc_id").agg(F.count("*").alias("segments"), F.max(F.length("text")).cast("long").alias("longest"))


@query("s16_page_snapshots", "SELECT url, substr(sha256(html), 1, 16) AS snapshot, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') AS title, CAST(len(list_distinct(regexp_extract_all(html, '(?i)href=[\"''](https?://[^\"''#\\s]+)', 1))) AS BIGINT) AS links FROM pages")
def s16_page_snapshots(t: Tables) -> DataFrame:
    return documents.page_snapshots(t("pages")).select("url", "snapshot", "title", F.size("links").cast("long").alias("links"))


_CUES = """(SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM conversations)"""


@query(
    "s14_captions",
    f"""WITH c AS (SELECT *, lag(text, 1) OVER w AS a, lag(text, 2) OVER w AS b, lag(text, 3) OVER w AS c FROM {_CUES} WHERE text <> '' WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS seq, CAST(turn AS DOUBLE) AS start, turn + 0.5 AS "end", text FROM c WHERE text IS DISTINCT FROM a AND text IS DISTINCT FROM b AND text IS DISTINCT FROM c""",
)
def s14_captions(t: Tables) -> DataFrame:
    """Conversations written as captions, a row for each cue, and read back as segments."""
    stamp = lambda end: F.format_string(f"%02d:%02d:%02d.{end}", F.floor(F.col("turn") / 3600), F.floor(F.col("turn") / 60) % 60, F.col("turn") % 60)
    cue = F.concat(stamp("0"), F.lit(" --> "), stamp("500"), F.lit("\n"), F.regexp_replace("text", r"\s+", " "))
    return documents.segments(t("conversations").select("conv_id", F.col("turn").alias("block"), cue.alias("cue")), "conv_id")


_WORD = "(?i)(price|stupid|licensed|card)"


@query("e6_moments", f"SELECT d.doc_id, regexp_extract(text, '{_WORD}', 1) AS word, CASE WHEN quality = 1 THEN 'kept' WHEN quality = 0 THEN 'dropped' ELSE 'new' END AS state FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE regexp_matches(text, '{_WORD}')")
def e6_moments(t: Tables) -> DataFrame:
    """Moments by key word; the state of an earlier review stays."""
    found = t("documents").where(F.col("text").rlike(_WORD)).select("doc_id", F.regexp_extract("text", _WORD, 1).alias("word"))
    reviewed = t("labels").select("doc_id", F.when(F.col("quality") == 1, "kept").otherwise("dropped").alias("state"))
    return found.join(reviewed, "doc_id", "left").select("doc_id", "word", F.coalesce("state", F.lit("new")).alias("state"))


@query("e1_upsert", "SELECT c_custkey, c_acctbal, seq FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY seq DESC) AS r FROM (SELECT c_custkey, c_acctbal, 0::BIGINT AS seq FROM customer UNION ALL SELECT c_custkey, c_acctbal + 1, 1 FROM customer WHERE c_custkey % 3 = 0)) WHERE r = 1")
def e1_upsert(t: Tables) -> DataFrame:
    old = t("customer").select("c_custkey", "c_acctbal", F.lit(0).cast("long").alias("seq"))
    new = t("customer").where("c_custkey % 3 = 0").select("c_custkey", (F.col("c_acctbal") + 1).alias("c_acctbal"), F.lit(1).cast("long").alias("seq"))
    return evidence.upsert(old, new, ["c_custkey"], "seq")


@query("e2_purge", "SELECT 'orders' AS name, count(*) AS n FROM orders WHERE o_custkey % 10 <> 0 UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 10 = 0)")
def e2_purge(t: Tables) -> DataFrame:
    """Synthetic customers go, then their orders, then those orders' lines."""
    tables = {"customer": t("customer").withColumn("synthetic", F.col("c_custkey") % 10 == 0), "orders": t("orders"), "lineitem": t("lineitem")}
    owners = t("orders").select(F.col("o_custkey").alias("c_custkey")).where("c_custkey % 10 = 0").distinct().withColumn("synthetic", F.lit(True))
    tables["customer"] = tables["customer"].select("c_custkey", "synthetic").union(owners).distinct()
    kept = evidence.purge(tables, [("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey")], "synthetic")
    return kept["orders"].agg(F.lit("orders").alias("name"), F.count("*").alias("n")).union(kept["lineitem"].agg(F.lit("lineitem").alias("name"), F.count("*").alias("n")))


@query("e3_violations", "SELECT l_orderkey, 'discount over 9%' AS problem FROM lineitem WHERE l_discount > 0.09 UNION ALL SELECT l_orderkey, 'unknown flag' FROM lineitem WHERE l_returnflag NOT IN ('A', 'N') UNION ALL SELECT l_orderkey, 'no tax' FROM lineitem WHERE l_tax = 0")
def e3_violations(t: Tables) -> DataFrame:
    rules = {"discount over 9%": F.col("l_discount") > 0.09, "unknown flag": ~F.col("l_returnflag").isin("A", "N"), "no tax": F.col("l_tax") == 0}
    return evidence.violations(t("lineitem"), "l_orderkey", rules)


@query("e4_quote_check", "SELECT b.item_id, count(*) AS holders FROM benchmark b JOIN documents d ON contains(lower(trim(regexp_replace(d.text, '\\s+', ' ', 'g'))), lower(trim(regexp_replace(b.text, '\\s+', ' ', 'g')))) GROUP BY b.item_id")
def e4_quote_check(t: Tables) -> DataFrame:
    """Documents that hold a quote word for word."""
    quotes = t("benchmark").select("item_id", X.normal(F.col("text")).alias("quote"))
    texts = t("documents").select("doc_id", X.normal(F.col("text")).alias("body"))
    return evidence.quote_holders(quotes, texts, "item_id", "quote", "doc_id", "body").groupBy("item_id").agg(F.count("*").alias("holders"))


@query("e8_lineage", "WITH RECURSIVE n AS (SELECT o_orderkey, (SELECT max(o_orderkey) FROM orders p WHERE p.o_custkey = o.o_custkey AND p.o_orderkey < o.o_orderkey) AS parent FROM orders o), a AS (SELECT o_orderkey AS start, o_orderkey, 0::BIGINT AS depth FROM orders UNION ALL SELECT start, parent, depth + 1 FROM a JOIN n ON n.o_orderkey = a.o_orderkey WHERE parent IS NOT NULL) SELECT start, o_orderkey, depth FROM a")
def e8_lineage(t: Tables) -> DataFrame:
    """Every order with all orders of its customer before it, by a pointer from each to the one before."""
    o = t("orders").select("o_orderkey", F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("parent"))
    return evidence.lineage(o, "o_orderkey", "parent", o.select("o_orderkey"))


@query("e9_candidate_merge", "WITH c AS (SELECT p_name || ' ' || p_type AS key, p_size AS priority, p_name || ' ' || p_brand AS note, p_partkey AS id FROM part) SELECT key, id AS evidence, min(priority) OVER (PARTITION BY key) AS priority, first_value(note) OVER (PARTITION BY key ORDER BY id) AS note, row_number() OVER (PARTITION BY key ORDER BY id) - 1 AS place FROM c")
def e9_candidate_merge(t: Tables) -> DataFrame:
    """Candidates of one key become one: its evidence a row each in order, with the highest priority and the first note."""
    c = t("part").select(F.concat_ws(" ", "p_name", "p_type").alias("key"), "p_size", F.concat_ws(" ", "p_name", "p_brand").alias("note"), F.col("p_partkey").alias("evidence"))
    best = c.groupBy("key").agg(F.min("p_size").alias("priority"), F.min_by("note", "evidence").alias("note"))
    placed = c.select("key", "evidence", (F.row_number().over(Window.partitionBy("key").orderBy("evidence")) - 1).cast("long").alias("place"))
    return placed.join(best, "key").select("key", "evidence", "priority", "note", "place")


@query("e10_ledger", "SELECT n_name AS source, string_agg(DISTINCT c_mktsegment, ';' ORDER BY c_mktsegment) AS kinds FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name UNION ALL SELECT r_name, 'candidate' FROM region")
def e10_ledger(t: Tables) -> DataFrame:
    named = t("customer").join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("source")).agg(F.array_join(F.array_sort(F.collect_set("c_mktsegment")), ";").alias("kinds"))
    return named.union(t("region").select("r_name", F.lit("candidate")))


@query("e11_filtered_listing", "SELECT doc_id, lang, source FROM documents WHERE lang = 'en' AND source = 'src0' AND n_chars > 1000")
def e11_filtered_listing(t: Tables) -> DataFrame:
    rows = t("documents")
    for name, value in {"lang": "en", "source": "src0"}.items():
        rows = rows.where(F.col(name) == value)
    return rows.where("n_chars > 1000").select("doc_id", "lang", "source")


@query(
    "e14_decision_windows",
    f"WITH {TICKS}, d AS (SELECT min(t) // 1000000 AS lo, max(t) // 1000000 AS hi FROM ticks), a AS (SELECT event_id, t // 1000000 AS s FROM ticks WHERE event_type = 'signup'), g AS (SELECT event_id, s + unnest(generate_series(-600, 600, 200)) AS at_s FROM a UNION SELECT event_id, s + unnest(generate_series(-5, 5, 1)) FROM a) SELECT event_id, CAST(at_s AS BIGINT) AS at_s FROM g, d WHERE at_s BETWEEN lo AND hi",
)
def e14_decision_windows(t: Tables) -> DataFrame:
    """A coarse grid and a dense one around an anchor, without repeats, clipped to the recording."""
    ticks = tape.ticks(t("events"))
    span = ticks.agg(F.floor(F.min("t") / 1_000_000).alias("lo"), F.floor(F.max("t") / 1_000_000).alias("hi"))
    a = ticks.where("event_type = 'signup'").select("event_id", F.floor(F.col("t") / 1_000_000).alias("s"))
    grid = F.concat(F.sequence(F.col("s") - 600, F.col("s") + 600, F.lit(200).cast("long")), F.sequence(F.col("s") - 5, F.col("s") + 5))
    rows = a.select("event_id", F.explode(F.array_distinct(grid)).alias("at_s"))
    return rows.crossJoin(F.broadcast(span)).where("at_s BETWEEN lo AND hi").select("event_id", "at_s")  # the span is one row


@query("e16_identity_dedupe", "SELECT p_brand AS handle, min(p_partkey) AS id FROM (SELECT coalesce(lower(p_brand), '') AS p_brand, p_partkey FROM part) GROUP BY 1")
def e16_identity_dedupe(t: Tables) -> DataFrame:
    return t("part").groupBy(F.coalesce(F.lower("p_brand"), F.lit("")).alias("handle")).agg(F.min("p_partkey").alias("id"))


@query("e17_fingerprint", f"WITH {TICKS} SELECT t // 86400000000 AS day, count(*) AS n, sha256(string_agg(sha256(event_id || chr(31) || key || chr(31) || event_type || chr(31) || t), '' ORDER BY event_id)) AS fingerprint FROM ticks GROUP BY 1")
def e17_fingerprint(t: Tables) -> DataFrame:
    """A hash of the events per day, over their ordered keys; equal data have equal hashes."""
    rows = tape.ticks(t("events")).withColumn("day", F.floor(F.col("t") / tape.DAY))
    return evidence.fingerprint(rows, ["day"], ["event_id"], ["event_id", "key", "event_type", "t"])


#: 1998-01-01 and 2000-01-01.
_FIRST_CUT, _SECOND_CUT = 883_612_800_000_000, 946_684_800_000_000
_SPLITS = f"""d AS (SELECT o_custkey AS split_set, o_orderkey AS run, o_totalprice AS price, epoch_us(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP)) AS t, o_orderstatus AS status FROM orders),
s AS (SELECT split_set, CASE WHEN t < {_FIRST_CUT} THEN 'train' WHEN t < {_SECOND_CUT} THEN 'validation' ELSE 'holdout' END AS name, min(t) AS lo, max(t) + CASE WHEN count(*) > 1 THEN (max(split_set) % 300) * 86400000000 ELSE 0 END AS hi FROM d GROUP BY ALL),
w AS (SELECT split_set, count(*) AS n, any_value(lo) FILTER (name = 'train') AS lo1, any_value(hi) FILTER (name = 'train') AS hi1, any_value(lo) FILTER (name = 'validation') AS lo2, any_value(hi) FILTER (name = 'validation') AS hi2, any_value(lo) FILTER (name = 'holdout') AS lo3, any_value(hi) FILTER (name = 'holdout') AS hi3 FROM s GROUP BY split_set)"""


@query(
    "e18_split_checks",
    f"""WITH {_SPLITS} SELECT split_set, 'not the three splits' AS problem FROM w WHERE n <> 3 UNION ALL SELECT split_set, 'train has no length' FROM w WHERE n = 3 AND hi1 <= lo1 UNION ALL SELECT split_set, 'validation has no length' FROM w WHERE n = 3 AND hi2 <= lo2
UNION ALL SELECT split_set, 'holdout has no length' FROM w WHERE n = 3 AND hi3 <= lo3 UNION ALL SELECT split_set, 'validation begins before train ends' FROM w WHERE n = 3 AND lo2 < hi1 UNION ALL SELECT split_set, 'holdout begins before validation ends' FROM w WHERE n = 3 AND lo3 < hi2""",
)
def e18_split_checks(t: Tables) -> DataFrame:
    """Customers' orders before, between and after two days taken as sets of splits, each with an embargo: which sets are not the
    three splits one after the other."""
    at = tape.day_of(F.col("o_orderdate"))
    name = F.when(at < _FIRST_CUT, "train").when(at < _SECOND_CUT, "validation").otherwise("holdout")
    spans = t("orders").groupBy(F.col("o_custkey").alias("split_set"), name.alias("name")).agg(F.min(at).alias("start"), F.max(at).alias("last"), F.count("*").alias("n"))
    spans = spans.withColumn("end", F.col("last") + F.when(F.col("n") > 1, F.col("split_set") % 300 * tape.DAY).otherwise(0))
    return evidence.split_problems(spans, "split_set", "name", "start", "end")


@query(
    "e18_holdout_once",
    f"""WITH {_SPLITS}, r AS (SELECT *, row_number() OVER (PARTITION BY split_set ORDER BY t, run) = 1 AS first FROM d WHERE status = 'F' AND t >= {_SECOND_CUT})
SELECT split_set, run, CASE WHEN first THEN 'evaluated' ELSE 'refused' END AS action, CASE WHEN NOT first THEN 'already used' WHEN price > 100000 AND price <= 400000 THEN 'passed' ELSE 'failed' END AS reason FROM r""",
)
def e18_holdout_once(t: Tables) -> DataFrame:
    """Runs on a set's holdout: the first is held against criteria registered before, all later ones are refused."""
    runs = t("orders").select(F.col("o_custkey").alias("split_set"), F.col("o_orderkey").alias("run"), F.col("o_totalprice").alias("price"), tape.day_of(F.col("o_orderdate")).alias("t"), "o_orderstatus").where((F.col("o_orderstatus") == "F") & (F.col("t") >= _SECOND_CUT))
    return evidence.holdout_log(runs, "split_set", ["t", "run"], [("price", ">", 100000.0), ("price", "<=", 400000.0)]).select("split_set", "run", "action", "reason")


@query("e12_worksheet", "SELECT lang, count(*) AS documents, count(quality) AS reviewed, round(count(quality) / count(*), 6) AS ratio FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY lang")
def e12_worksheet(t: Tables) -> DataFrame:
    j = t("documents").join(t("labels"), "doc_id", "left")
    return j.groupBy("lang").agg(F.count("*").alias("documents"), F.count("quality").alias("reviewed"), F.round(F.count("quality") / F.count("*"), 6).alias("ratio"))


@query("e15_cited", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 UNION SELECT doc_id FROM labels WHERE quality = 1)")
def e15_cited(t: Tables) -> DataFrame:
    cited = t("labels").where("toxic = 1").select("doc_id").union(t("labels").where("quality = 1").select("doc_id"))
    return t("documents").join(cited, "doc_id", "left_semi").select("doc_id")


@query("e13_fetch_log", "SELECT event_type || ':' || CASE WHEN value > 50 THEN 'ok' ELSE 'low' END AS status, count(*) AS n, max(event_id) AS last FROM events GROUP BY 1")
def e13_fetch_log(t: Tables) -> DataFrame:
    status = F.concat_ws(":", "event_type", F.when(F.col("value") > 50, "ok").otherwise("low"))
    return t("events").groupBy(status.alias("status")).agg(F.count("*").alias("n"), F.max("event_id").alias("last"))


@query("e20_transcript_lines", "SELECT conv_id, turn, '[' || printf('%02d:%02d:%02d', turn // 3600, (turn // 60) % 60, turn % 60) || '] ' || role || ': ' || text AS line FROM conversations")
def e20_transcript_lines(t: Tables) -> DataFrame:
    return t("conversations").select("conv_id", "turn", F.concat(F.lit("["), C.hms(F.col("turn")), F.lit("] "), "role", F.lit(": "), "text").alias("line"))


@query("s28_flag_table", f"WITH {TICKS} SELECT key, CAST(arg_min(props->>'$.k', (t, event_id)) AS BIGINT) AS flag FROM ticks GROUP BY key")
def s28_flag_table(t: Tables) -> DataFrame:
    """The flag of each key's first message."""
    flag = F.get_json_object("props", "$.k").cast("long")
    return tape.ticks(t("events")).groupBy("key").agg(F.min(F.struct("t", "event_id", flag.alias("flag"))).alias("x")).select("key", "x.flag")


_TITLES = "titles AS (SELECT o_orderkey AS code, CAST(o_orderdate AS DATE) AS day, CASE o_orderstatus WHEN 'F' THEN 'Exchange Will Delist ' || c_mktsegment || ', ' || o_orderpriority || ' and GHOST on ' || CAST(CAST(o_orderdate AS DATE) AS VARCHAR) WHEN 'O' THEN 'Exchange Will Extend the Monitoring Tag to Include ' || c_mktsegment || ' & ' || o_orderpriority ELSE 'Exchange Adds ' || c_mktsegment END AS title FROM orders JOIN customer ON o_custkey = c_custkey)"


@query(
    "s25_announcements",
    f"""WITH {DAILY}, {_TITLES}, e AS (SELECT code, day, 'delist' AS kind, regexp_extract(title, 'Will Delist (.+) on [0-9-]+$', 1) AS tokens FROM titles WHERE regexp_matches(title, 'Will Delist (.+) on [0-9-]+$')
 UNION ALL SELECT code, day, 'monitor', regexp_extract(title, 'Monitoring Tag to Include (.+)$', 1) FROM titles WHERE regexp_matches(title, 'Monitoring Tag to Include (.+)$')),
k AS (SELECT code, day, kind, unnest(regexp_split_to_array(tokens, '\\s*,\\s*|\\s+and\\s+|\\s*&\\s*')) AS token FROM e), f AS (SELECT symbol, min(day) AS first FROM daily GROUP BY symbol)
SELECT code, kind, token, d.symbol, CAST(d.day - f.first AS BIGINT) AS age_days, CASE WHEN d.symbol IS NOT NULL THEN 'ok' WHEN f.symbol IS NOT NULL THEN 'no bar' ELSE 'no symbol' END AS note FROM k
LEFT JOIN f ON f.symbol = k.token LEFT JOIN daily d ON d.symbol = k.token AND d.day = date_diff('day', DATE '1970-01-01', k.day) + CASE WHEN kind = 'monitor' THEN 1 ELSE 0 END""",
)
def s25_announcements(t: Tables) -> DataFrame:
    """Titles to a row per token by two patterns, each with its symbol and that symbol's age if it has a bar on the day it counts from."""
    o, c = F.col("o_orderpriority"), F.col("c_mktsegment")
    said = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("Exchange Will Delist "), c, F.lit(", "), o, F.lit(" and GHOST on "), F.to_date("o_orderdate").cast("string"))).when(F.col("o_orderstatus") == "O", F.concat(F.lit("Exchange Will Extend the Monitoring Tag to Include "), c, F.lit(" & "), o)).otherwise(F.concat(F.lit("Exchange Adds "), c))
    titles = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("code"), F.unix_date(F.to_date("o_orderdate")).cast("long").alias("day"), said.alias("title"))
    events = documents.announced(titles, "title", {"delist": r"Will Delist (.+) on [0-9-]+$", "monitor": r"Monitoring Tag to Include (.+)$"})
    bars = tape.daily(t("orders"), t("customer")).select("symbol", "day")
    first = bars.groupBy("symbol").agg(F.min("day").alias("first")).select(F.col("symbol").alias("token"), "first")
    events = events.withColumn("day", F.col("day") + (F.col("kind") == "monitor").cast("long"))
    j = events.join(first, "token", "left").join(bars.withColumn("token", F.col("symbol")), ["token", "day"], "left")
    note = F.when(F.col("symbol").isNotNull(), "ok").when(F.col("first").isNotNull(), "no bar").otherwise("no symbol")
    return j.select("code", "kind", "token", "symbol", F.when(F.col("symbol").isNotNull(), F.col("day") - F.col("first")).alias("age_days"), note.alias("note"))


@query(
    "s17_polls",
    f"""WITH {TAPE}, polls AS (SELECT recv // 60000000 AS minute, count(*) AS n FROM tape GROUP BY ALL) SELECT minute * 60000 AS recv_ms, n, mint, round(sum(tok), 2) AS viewers, bool_or(buy) AS complete FROM tape JOIN polls ON minute = recv // 60000000 GROUP BY ALL""",
)
def s17_polls(t: Tables) -> DataFrame:
    """Polls as answers in JSON, each sent twice and some failed: one row for each coin of every poll that counts once."""
    minute = F.floor(F.col("recv") / 60_000_000)
    coins = prints(t).groupBy(minute.alias("minute"), "mint").agg(F.round(F.sum("tok"), 2).alias("viewers"), F.bool_or("buy").alias("complete"), F.count("*").alias("k"))
    sent = coins.groupBy("minute").agg(F.struct(F.sum("k").alias("n"), F.collect_list(F.struct("mint", "viewers", "complete")).alias("coins")).alias("x"))
    body = F.to_json(F.struct((F.col("minute") * 60).cast("double").alias("recv"), F.col("x.n").alias("n"), F.col("x.coins").alias("coins")))
    failed = F.to_json(F.struct((F.col("minute") * 60).cast("double").alias("recv"), F.lit("timed out").alias("error")))
    lines = sent.select(F.explode(F.array(body, body, failed)).alias("line"))
    return feeds.poll_rows(lines, "line", "mint long, viewers double, complete boolean")
