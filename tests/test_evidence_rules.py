"""Rules of findings, hypotheses and splits on hand-made rows."""

import pytest
from tapespark.operators import evidence

TARGETS = "kind string, id long, modality string, trader long, etype string, split string, synthetic boolean"
FINDINGS = "finding long, etype string, trader long, n_supporting long, n_observable long, synthetic boolean"


def test_rules_of_each_type(spark):
    findings = spark.createDataFrame(
        [(1, "stated", 7, None, None, False), (2, "stated", 7, None, None, False), (3, "observed", 7, 3, 2, False), (4, "observed", 7, 2, 3, None), (5, "inferred", None, None, None, False),
         (6, "validated", None, None, None, False), (7, "validated", None, None, None, True), (8, "inferred", None, None, None, None), (9, "observed", None, None, 4, None)], FINDINGS)
    links = spark.createDataFrame(
        [(1, "observation", 10, "supports"), (2, "observation", 11, "supports"), (4, "decision", 30, "supports"), (5, "finding", 1, "derived_from"), (6, "sim_run", 20, "validated_by"), (6, "finding", 5, "derived_from"),
         (7, "sim_run", 20, "validated_by"), (7, "finding", 5, "derived_from"), (8, "finding", 99, "derived_from"), (8, "finding", 99, "derived_from")], "finding long, kind string, id long, relation string")
    targets = spark.createDataFrame(
        [("observation", 10, "said", 7, None, None, None), ("observation", 11, "said", None, None, None, None), ("decision", 30, None, None, None, None, None), ("sim_run", 20, None, None, None, "holdout", True),
         ("finding", 1, None, None, "stated", None, None), ("finding", 5, None, None, "inferred", None, None)], TARGETS)
    found = {(r[0], r[1]) for r in evidence.finding_problems(findings, links, targets).collect()}
    assert found == {
        (2, "words of another trader"), (3, "no decision and nothing seen"), (3, "counts out of order"), (6, "no run on validation or holdout data"),
        (8, "derived from no stated or observed finding"), (8, "links missing finding 99"), (9, "no decision and nothing seen"), (9, "no counts"),
    }
    assert evidence.finding_problems(findings.limit(0), links, targets.limit(0)).where("problem NOT LIKE 'links%'").count() == 0


def test_hypotheses_rest_on_findings(spark):
    hypotheses = spark.createDataFrame([(1, None), (2, None), (3, 1), (4, None)], "hypothesis long, parent long")
    basis = spark.createDataFrame([(1, 5), (1, 9), (2, 9)], "hypothesis long, finding long")
    found = {(r[0], r[1]) for r in evidence.hypothesis_problems(hypotheses, basis, spark.createDataFrame([(5,)], "finding long")).collect()}
    assert found == {(1, "1 basis findings are gone"), (2, "1 basis findings are gone"), (2, "a root without basis"), (4, "a root without basis")}


def test_splits_and_holdout(spark):
    rows = [(1, "train", 0, 5), (1, "validation", 5, 9), (1, "holdout", 9, 12), (2, "train", 0, 5), (2, "validation", 4, 9), (2, "holdout", 9, 9), (3, "train", 0, 5), (3, "holdout", 6, 9), (4, "train", 0, 1), (4, "validation", 2, 3), (4, "holdout", 4, 5), (4, "more", 6, 7)]
    splits = spark.createDataFrame(rows, "s long, name string, lo long, hi long")
    found = {(r[0], r[1]) for r in evidence.split_problems(splits, "s", "name", "lo", "hi").collect()}
    assert found == {(2, "validation begins before train ends"), (2, "holdout has no length"), (3, "not the three splits"), (4, "not the three splits")}
    runs = spark.createDataFrame([(1, 5, 2.0), (1, 3, None), (2, 1, 1.0), (3, 1, 0.0)], "s long, at long, net double")
    log = {(r["s"], r["at"]): (r["action"], r["reason"], r["failed"]) for r in evidence.holdout_log(runs, "s", ["at"], [("net", ">", 0.0)]).collect()}
    assert log == {(1, 3): ("evaluated", "failed", ["net > 0.0"]), (1, 5): ("refused", "already used", None), (2, 1): ("evaluated", "passed", []), (3, 1): ("evaluated", "failed", ["net > 0.0"])}
    with pytest.raises(ValueError):
        evidence.holdout_log(runs, "s", ["at"], [])
