"""SpotSigs fingerprints: chains of content words that follow common words; DataFrame functions only.

A text's signature set has, for every common word (anchor), the anchor with the next ``CHAIN`` content words among the
``REACH`` words after it. Words beyond the reach of any such chain give their runs of ``CHAIN`` + 1 words: a signature depends
on the words near it alone, so an edit elsewhere takes none away. A text of at most ``CHAIN`` words falls back to them as one,
and one without words to itself; only the empty text has no signature. The fingerprint is the sorted set.

``near_pairs`` compares sets of like length only: documents are partitioned by set length, a pair can meet on one of the
rarest signatures of both (the prefix that any pair of the similarity must share), and lengths prune it before the exact
Jaccard is taken.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import input_bytes, materialize
from .pii import let

CHAIN, REACH = 2, 8
BUCKET_BYTES, MAX_BUCKETS = 2 << 20, 200_000
# The anchors, common words of English, German, French and Spanish.
ANCHORS = (
    "a an and are as at be by for from has have he her his i in is it its not of on or she that the their they this to was we were which will with you "
    "als auch auf aus bei das dass dem den der des die ein eine einer es für hat ich im ist man mit nach nicht oder sich sie sind über um und von war wie wird zu zum zur "
    "au aux avec ce cette dans de du elle en est et être il ils la le les leur mais ne ou où par pas plus pour qu que qui sa se ses son sont sur un une "
    "al como con del el ella ellos era es esta este fue ha hay las lo los más me mi muy no para pero por se si sin su sus también una unos y ya"
).split()
_SPLIT = r"[\x00-\x20!-/:-@\[-`{-~]+"


def signatures(text: Column) -> Column:
    """The sorted set of signature hashes of a text that is not null."""

    def of(words: Column) -> Column:
        anchor = lambda w: w.isin(ANCHORS)

        def chain(w: Column, i: Column) -> Column:
            follow = F.filter(F.slice(words, i + 2, F.lit(REACH)), lambda x: ~anchor(x))
            return F.when(anchor(w), let(follow, lambda f: F.when(F.size(f) >= CHAIN, F.xxhash64(w, *(F.element_at(f, k) for k in range(1, CHAIN + 1))))))

        def run(i: Column) -> Column:
            return F.xxhash64(*(F.element_at(words, i + k) for k in range(CHAIN + 1)))

        def runs(spots: Column) -> Column:
            """Of the stretches that begin after the reach of one chain's anchor and end before the next one."""
            edges = F.concat(F.array(F.lit(-REACH)), spots, F.array(F.size(words) + 1))
            ends = let(edges, lambda e: F.transform(F.sequence(F.lit(1), F.size(e) - 1), lambda k: F.struct((F.element_at(e, k) + REACH + 1).alias("a"), (F.element_at(e, k + 1) - CHAIN - 1).alias("b"))))
            return F.flatten(F.transform(F.filter(ends, lambda x: x["a"] <= x["b"]), lambda x: F.transform(F.sequence(x["a"], x["b"]), run)))

        def both(chains: Column) -> Column:
            found = F.filter(chains, lambda s: s.isNotNull())
            spots = F.filter(F.transform(chains, lambda s, i: F.when(s.isNotNull(), i + 1)), lambda i: i.isNotNull())
            return F.concat(found, runs(spots))

        several = let(F.transform(words, chain), both)
        return F.when(F.size(words) > CHAIN, several).otherwise(F.array(F.xxhash64(F.array_join(words, " "))))

    words = F.filter(F.split(F.lower(text), _SPLIT), lambda w: w != "")
    whole = let(words, lambda w: F.when(F.size(w) > 0, of(w)).otherwise(F.array(F.xxhash64(text))))
    return F.when(F.length(text) > 0, F.array_sort(F.array_distinct(F.transform(whole, lambda s: F.shiftright(s, 24))))).otherwise(F.array().cast("array<bigint>"))


def fingerprint(sigs: Column) -> Column:
    """The set as text: ten hexadecimal digits for each signature."""
    return F.array_join(F.transform(sigs, lambda s: F.right(F.hex(s + (1 << 40)), F.lit(10))), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets; 1 for two empty ones."""
    shared = F.size(F.array_intersect(a, b))
    return let(shared, lambda i: F.when(F.size(a) + F.size(b) > 0, i / (F.size(a) + F.size(b) - i)).otherwise(F.lit(1.0)))


def _bucket(key: Column, table: Column, most: int) -> Column:
    """Number of the sorted bounds in ``table``, of which there are ``most`` or fewer, that lie below the key, by binary search; -1 for null."""

    def step(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        higher = F.struct((mid + 1).alias("lo"), s["hi"].alias("hi"))
        lower = F.struct(s["lo"].alias("lo"), mid.alias("hi"))
        return F.when(s["lo"] >= s["hi"], s).when(F.element_at(table, mid + 1) < key, higher).otherwise(lower)

    steps = F.sequence(F.lit(1), F.lit(max(1, math.ceil(math.log2(most + 1)) + 1)))
    found = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(table).alias("hi")), step, lambda s: s["lo"])
    return F.when(key.isNull(), -1).otherwise(found)


def _chained(docs: DataFrame) -> DataFrame:
    """Documents dealt to buckets of doc_id ranges, each with a copy of the first document of the next range as its last row.

    Only the bounds of the ranges, at most ``MAX_BUCKETS``, pass through the driver; texts are shuffled once.
    """
    spark = docs.sparkSession
    buckets = min(MAX_BUCKETS, max(1, math.ceil(input_bytes(docs, "text") / BUCKET_BYTES)))
    if buckets > 1:
        marks = [k / buckets for k in range(1, buckets)]
        bounds = docs.agg(F.percentile_approx("doc_id", marks, 4 * buckets + 1000).alias("q"))
        bounds = materialize(bounds.select(F.array_distinct(F.coalesce("q", F.array().cast("array<bigint>"))).alias("bounds")), "spot-bounds")
        # one row of at most MAX_BUCKETS numbers
        docs = docs.join(F.broadcast(bounds), F.lit(True)).withColumn("bucket", _bucket(F.col("doc_id"), F.col("bounds"), buckets)).drop("bounds")
    else:
        docs = docs.withColumn("bucket", F.when(F.col("doc_id").isNull(), -1).otherwise(0))
    firsts = sorted(docs.groupBy("bucket").agg(F.max("doc_id").alias("doc_id")).collect(), key=lambda r: -r["bucket"])
    to = [(firsts[k]["doc_id"], firsts[k - 1]["bucket"]) for k in range(len(firsts))]
    known = spark.createDataFrame([x for x in to if x[0] is not None], "doc_id long, bucket int")
    guests = docs.drop("bucket").join(F.broadcast(known), "doc_id").select("doc_id", "text", "bucket")
    if to and firsts[-1]["bucket"] == -1:
        guests = guests.union(docs.where("doc_id IS NULL").agg(F.min("text").alias("text")).select(F.lit(None).cast("long"), "text", F.lit(to[-1][1])))
    return docs.withColumn("guest", F.lit(False)).unionByName(guests.withColumn("guest", F.lit(True))).repartition("bucket")


def edited_pairs(docs: DataFrame) -> DataFrame:
    """doc_id, text, edited (its last third replaced by the beginning of the next document), and the signature sets of the two and of the next.

    The next document is that of the next lower doc_id, after the last the first. A null text counts as empty; null ids come
    last; equal ids are ordered by text. Every row of ``docs`` gives a row.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    w = Window.partitionBy("bucket").orderBy("guest", F.col("doc_id").desc_nulls_last(), "text")
    rows = _chained(docs).withColumn("sigs", signatures(F.col("text")))
    rows = rows.withColumn("next_text", F.lead("text").over(w)).withColumn("next_sigs", F.lead("sigs").over(w)).where("NOT guest")
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.left("text", n - cut), F.left("next_text", cut))
    return rows.withColumn("edited", edited).withColumn("edited_sigs", signatures(F.col("edited"))).select("doc_id", "text", "edited", "sigs", "edited_sigs", "next_sigs")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, the sha256 of the edited text, both fingerprints, and the likeness of a document's to its edited text's and to the next document's."""
    return edited_pairs(docs).select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("sigs")).alias("fingerprint"),
        fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )


def near_pairs(docs: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(pairs of class representatives a > b whose sets have the similarity, with it; doc_id and its class's representative).

    A class is the documents of one signature set, its representative the smallest doc_id; empty sets and null ids are in none.
    """
    sets = docs.where("doc_id IS NOT NULL").select("doc_id", signatures(F.coalesce(F.col("text"), F.lit(""))).alias("sigs")).where(F.size("sigs") > 0)
    members = materialize(sets, "spot-sets")
    reps = members.groupBy("sigs").agg(F.min("doc_id").alias("rep"))
    members = members.join(reps, "sigs").select("doc_id", "rep")
    reps = materialize(reps.select("rep", "sigs", F.size("sigs").alias("n")), "spot-reps")
    spread = reps.select("rep", "n", F.explode("sigs").alias("sig"))
    spread = spread.join(spread.groupBy("sig").agg(F.count("*").alias("df")), "sig")
    place = F.row_number().over(Window.partitionBy("rep").orderBy("df", "sig"))
    prefix = spread.withColumn("place", place).where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1)
    length = lambda n: F.floor(F.log(n) / math.log(1 / threshold)).cast("int")
    prefix = prefix.withColumn("part", length(F.col("n").cast("double")))
    left = prefix.select("sig", "part", F.col("rep").alias("a"), F.col("n").alias("na"))
    right = prefix.select("sig", F.explode(F.array(F.col("part") - 1, F.col("part"), F.col("part") + 1)).alias("part"), F.col("rep").alias("b"), F.col("n").alias("nb"))
    fits = F.least("na", "nb") >= F.greatest("na", "nb") * threshold - 1e-9
    pairs = left.join(right, ["sig", "part"]).where((F.col("a") > F.col("b")) & fits).select("a", "b").distinct()
    of = lambda p: reps.select(F.col("rep").alias(p), F.col("sigs").alias(f"s_{p}"))
    pairs = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", likeness(F.col("s_a"), F.col("s_b")).alias("similarity"))
    return pairs.where(F.col("similarity") >= threshold - 1e-9), members
