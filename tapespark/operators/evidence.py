"""Keyed tables of evidence: upsert, purge, rules, quotes, lineage, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import scratch


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """All rows by key, the one loaded last wins; a missing column is null."""
    both = old.unionByName(new, allowMissingColumns=True)
    last = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return both.withColumn("__r", F.row_number().over(last)).where("__r = 1").drop("__r")


def purge(tables: dict[str, DataFrame], children: list[tuple[str, str, str, str]], flag: str) -> dict[str, DataFrame]:
    """Drop flagged rows, then rows whose parent went: ``children`` lists (child, column, parent, key), parents first."""
    gone = {name: df.where(F.coalesce(F.col(flag), F.lit(False))) for name, df in tables.items() if flag in df.columns}
    kept = {name: df.where(~F.coalesce(F.col(flag), F.lit(False))) if flag in df.columns else df for name, df in tables.items()}
    for child, column, parent, key in children:
        lost = gone[parent].select(F.col(key).alias(column)).distinct()
        taken = kept[child].join(lost, column, "left_semi")
        kept[child] = kept[child].join(lost, column, "left_anti")
        gone[child] = gone[child].unionByName(taken, allowMissingColumns=True) if child in gone else taken
    return kept


def violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, problem) for every rule that a row breaks; a rule that is null is not broken."""
    found = F.array(*(F.when(bad, F.lit(message)) for message, bad in rules.items()))
    return rows.select(key, F.explode(F.filter(found, lambda m: m.isNotNull())).alias("problem"))


def lineage(nodes: DataFrame, key: str, parent: str, leaf: DataFrame) -> DataFrame:
    """Rows (start, key, depth): each leaf and its ancestors, depth 0 first, until none has a parent.

    Pointers are doubled: after k rounds a row knows the ancestor 2^k steps up, so the rounds are the logarithm of the longest
    line; each is written to the shared folder. A cycle raises.
    """
    links = nodes.where(F.col(parent).isNotNull()).select(F.col(key).alias("a"), F.col(parent).alias("b")).distinct()
    jumps = scratch.written(links, "lineage-jumps")
    most = jumps.count()
    found = scratch.written(leaf.select(F.col(key).alias("start"), F.col(key).alias("at"), F.lit(0).cast("long").alias("depth")), "lineage-rows")
    steps = 1
    while True:
        more = found.join(jumps, F.col("at") == F.col("a")).select("start", F.col("b").alias("at"), (F.col("depth") + steps).alias("depth"))
        found = scratch.written(found.union(more), "lineage-rows")
        far = jumps.select(F.col("a").alias("x"), F.col("b").alias("m")).join(jumps, F.col("m") == F.col("a")).select(F.col("x").alias("a"), "b")
        jumps, steps = scratch.written(far, "lineage-jumps"), 2 * steps
        if jumps.isEmpty():
            return found.select("start", F.col("at").alias(key), "depth")
        if steps > most:
            raise ValueError("a node is its own ancestor")


def quote_found(quote: Column, texts: Column) -> Column:
    """True if a normalised quote is in the joined texts; null if there is nothing to check."""
    from ..functions.text import normal

    return F.when(quote.isNull() | (F.trim(quote) == "") | texts.isNull(), None).otherwise(F.contains(normal(texts), normal(quote)))


#: Characters of quotes that are looked up in one pass of the texts.
_QUOTES = 1 << 25


def quote_holders(quotes: DataFrame, texts: DataFrame, item: str, quote: str, doc: str, body: str) -> DataFrame:
    """(item, doc): the texts that hold a quote, a row each; both are normalised, blank quotes are in none.

    A quote may begin and end inside a word of a text. So quotes of three words or more meet texts on their inner words, the
    first four of them at most: those of each place of a text are looked up among the quotes', and what meets is compared there
    with the whole quote, so that no text is shuffled. A pass takes quotes of 32 M characters. Quotes of two words meet texts on the end of
    the word that the first is, single words on parts of the texts' distinct words; these pairs are then compared with the whole text.
    """
    words = F.split(F.col(quote), " ")
    q = quotes.where(F.trim(quote) != "").select(item, quote, F.size(words).alias("k"), F.least(F.size(words) - 2, F.lit(4)).alias("n"))
    w = texts.where(F.col(body).isNotNull()).select(doc, F.monotonically_increasing_id().alias("__text"), F.split(F.col(body), " ").alias("w"))
    used = {r["n"]: r["size"] for r in q.groupBy("n").agg(F.sum(F.length(quote)).alias("size")).collect()}  # six numbers at most
    gram = lambda of, first, n: F.xxhash64(*(F.get(of, first + j) for j in range(n)))
    found = []
    for n in [n for n in used if n > 0]:
        passes = used[n] // _QUOTES + 1
        inner = q.where(F.col("n") == n).select(item, quote, "k", gram(words, F.lit(1), n).alias("gram"))
        for part in range(passes):
            some = inner.where(F.pmod(F.xxhash64(item), F.lit(passes)) == part) if passes > 1 else inner
            places = w.select(doc, "__text", "w", F.posexplode("w").alias("pos", "word")).where("pos > 0").select(doc, "__text", "w", "pos", gram(F.col("w"), F.col("pos"), n).alias("gram"))
            near = F.array_join(F.slice("w", F.col("pos"), F.col("k")), " ")
            found.append(places.join(F.broadcast(some), "gram").where(F.contains(near, F.col(quote))).select(item, quote, doc, "__text").distinct().select(item, doc))
    met = []
    if any(n <= 0 for n in used):
        short = q.withColumn("gram", F.get(words, F.lit(0)))
        held = w.select(doc, F.explode(F.array_distinct("w")).alias("word"))
        ends = held.select("word").distinct().where("word <> ''").select("word", F.explode(F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.substring(F.col("word"), i, F.length("word")))).alias("gram"))
        if 0 in used:
            met.append(ends.join(short.where("n = 0"), "gram").join(held, "word"))
        if -1 in used:
            sizes = [r["k"] for r in short.where("n = -1").select(F.length("gram").alias("k")).distinct().collect()]  # lengths of words
            parts = ends.select("word", F.explode(F.array(*(F.when(F.length("gram") >= k, F.left("gram", F.lit(k))) for k in sizes))).alias("gram")).where("gram IS NOT NULL").distinct()
            met.append(parts.join(short.where("n = -1"), "gram").join(held, "word"))
    if met:
        pairs = met[0].select(item, quote, doc)
        for more in met[1:]:
            pairs = pairs.union(more.select(item, quote, doc))
        found.append(pairs.distinct().join(texts.select(doc, body), doc).where(F.contains(F.col(body), F.col(quote))).select(item, doc))
    if not found:
        return quotes.sparkSession.createDataFrame([], StructType([quotes.schema[item], texts.schema[doc]]))
    all_found = found[0]
    for more in found[1:]:
        all_found = all_found.union(more)
    return all_found


def fingerprint(rows: DataFrame, by: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Per group the number of rows and the sha256 over the rows' own, in order; 64 characters of each row stand in one string,
    so groups are to be days or the like."""
    own = F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), 256)
    ordered = F.array_sort(F.collect_list(F.struct(*order, own.alias("__own"))))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), ordered.alias("__all")).select(*by, "n", F.sha2(F.array_join(F.transform("__all", lambda x: x["__own"]), ""), 256).alias("fingerprint"))


def finding_problems(findings: DataFrame, links: DataFrame, targets: DataFrame) -> DataFrame:
    """(finding, problem): what the evidence of each finding lacks by the rules of its type.

    ``findings``: finding, etype, trader, n_supporting, n_observable, synthetic. ``links``: finding, kind, id, relation. ``targets``,
    all that links may point to: kind, id, modality and trader (observation), etype (finding), split and synthetic (sim_run).
    Stated ones need words that support them, of their own trader; observed ones a decision or something seen, and both counts
    in order; inferred ones a stated or observed finding behind them; validated ones a run on validation or holdout data, not a
    synthetic one unless they are synthetic, and a finding behind them. A link to nothing is a problem of every type.
    """
    there = targets.select("kind", "id", F.struct("modality", F.col("trader").alias("who"), F.col("etype").alias("type"), "split", F.col("synthetic").alias("made")).alias("x"))
    met = links.join(there, ["kind", "id"], "left")
    missing = met.where("x IS NULL").select("finding", F.concat_ws(" ", F.lit("links missing"), "kind", F.col("id").cast("string")).alias("problem")).distinct()
    kind = lambda name, relation: (F.col("kind") == name) & (F.col("relation") == relation) & F.col("x").isNotNull()
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    own = findings.select("finding", F.col("trader").alias("of"), F.col("synthetic").alias("free"))
    said = kind("observation", "supports") & (F.col("x.modality") == "said")
    run = kind("sim_run", "validated_by") & F.col("x.split").isin("validation", "holdout") & (~F.coalesce(F.col("x.made"), F.lit(False)) | F.coalesce(F.col("free"), F.lit(False)))
    base = kind("finding", "derived_from")
    counts = met.join(own, "finding").groupBy("finding").agg(
        n(said).alias("said"), n(said & F.col("of").isNotNull() & ~F.col("x.who").eqNullSafe(F.col("of"))).alias("foreign"),
        n((F.col("kind") == "decision") & (F.col("relation") == "supports") | kind("observation", "supports") & F.col("x.modality").isin("screen", "action", "onchain")).alias("seen"),
        n(run).alias("runs"), n(base & F.col("x.type").isin("stated", "observed")).alias("on_facts"), n(base & F.col("x.type").isin("stated", "observed", "inferred")).alias("on_any"),
    )
    f = findings.join(counts, "finding", "left").fillna(0, ["said", "foreign", "seen", "runs", "on_facts", "on_any"])
    of = lambda name, bad: (F.col("etype") == name) & bad
    unknown = F.col("n_supporting").isNull() | F.col("n_observable").isNull()
    rules = {
        "no words that support it": of("stated", F.col("said") == 0),
        "words of another trader": of("stated", F.col("foreign") > 0),
        "no decision and nothing seen": of("observed", F.col("seen") == 0),
        "no counts": of("observed", unknown),
        "counts out of order": of("observed", ~F.col("n_supporting").between(0, F.col("n_observable"))),
        "derived from no stated or observed finding": of("inferred", F.col("on_facts") == 0),
        "no run on validation or holdout data": of("validated", F.col("runs") == 0),
        "derived from no finding": of("validated", F.col("on_any") == 0),
    }
    return violations(f, "finding", rules).unionByName(missing)


def hypothesis_problems(hypotheses: DataFrame, basis: DataFrame, findings: DataFrame) -> DataFrame:
    """(hypothesis, problem): basis findings that are gone, and roots (no parent) that rest on none. ``basis``: hypothesis, finding."""
    known = findings.select("finding", F.lit(True).alias("there")).distinct()
    counts = basis.join(known, "finding", "left").groupBy("hypothesis").agg(F.count("*").alias("n"), F.count_if(F.col("there").isNull()).alias("gone"))
    h = hypotheses.select("hypothesis", "parent").join(counts, "hypothesis", "left").fillna(0, ["n", "gone"])
    lost = h.where("gone > 0").select("hypothesis", F.concat_ws(" ", F.col("gone").cast("string"), F.lit("basis findings are gone")).alias("problem"))
    return violations(h, "hypothesis", {"a root without basis": F.col("parent").isNull() & (F.col("n") == F.col("gone"))}).unionByName(lost)


#: The splits of a set, in order of time.
SPLITS = ("train", "validation", "holdout")


def split_problems(splits: DataFrame, by: str, name: str, start: str, end: str) -> DataFrame:
    """(by, problem) of sets of splits: one that is not exactly the three, a split without length, one that begins before the one
    before it has ended. A set is a few rows, taken as one array of what is wanted."""
    every = splits.groupBy(by).agg(F.count("*").alias("n"), *(F.max(F.when(F.col(name) == s, F.struct(F.col(start).alias("lo"), F.col(end).alias("hi")))).alias(s) for s in SPLITS))
    whole = (F.col("n") == 3) & F.col("train").isNotNull() & F.col("validation").isNotNull() & F.col("holdout").isNotNull()
    rules = {"not the three splits": ~whole}
    rules |= {f"{s} has no length": whole & (F.col(s)["hi"] <= F.col(s)["lo"]) for s in SPLITS}
    rules |= {f"{b} begins before {a} ends": whole & (F.col(b)["lo"] < F.col(a)["hi"]) for a, b in zip(SPLITS, SPLITS[1:], strict=False)}
    return violations(every, by, rules)


def holdout_log(runs: DataFrame, by: str, order: list[str], criteria: list[tuple[str, str, float]]) -> DataFrame:
    """``runs`` on holdouts with ``action``, ``reason`` and ``failed``: the first run of a set (the holdout is used up by it) is
    evaluated and passes if all (column, operator, value) hold, the criteria that it fails in ``failed``; all later ones are refused.
    A column that is null fails."""
    if not criteria:
        raise ValueError("criteria are registered before the holdout is seen")
    tests = {">": "__gt__", ">=": "__ge__", "<": "__lt__", "<=": "__le__"}
    checks = F.array(*(F.when(~F.coalesce(getattr(F.col(c), tests[op])(value), F.lit(False)), F.lit(f"{c} {op} {value}")) for c, op, value in criteria))
    first = runs.groupBy(by).agg(F.min(F.struct(*order)).alias("__first"))
    r = runs.join(first, by).withColumn("__is", F.struct(*order) == F.col("__first")).withColumn("failed", F.when(F.col("__is"), F.filter(checks, lambda m: m.isNotNull())))
    action = F.when(F.col("__is"), "evaluated").otherwise("refused")
    reason = F.when(~F.col("__is"), "already used").when(F.size("failed") == 0, "passed").otherwise("failed")
    return r.withColumn("action", action).withColumn("reason", reason).drop("__first", "__is")
