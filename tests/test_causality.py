"""Triggers know nothing of what comes after them: cutting the tape at a time changes no trigger up to that time."""

import pytest
from pyspark.sql import functions as F

from tapespark import plans
from tapespark.plans import composites, snapshots, tape
from tapespark.plans.registry import Tables

SF = "/root/testdata/sf0.001"


class Cut(Tables):
    """The tables, with the tape's prints up to a day only."""

    def __init__(self, spark, day):
        super().__init__(spark, SF)
        self.day = day

    def __call__(self, name):
        rows = super().__call__(name)
        return rows.where(F.col("l_shipdate") < F.lit(self.day).cast("timestamp_ntz")) if name == "lineitem" else rows


#: A trigger's plan and the column of its time; what is known later (buyers after a crash) is left out.
TRIGGERS = {
    "c5": (snapshots.c5_snapshot_features, "t", []),
    "c8": (composites.c8_hot_trigger, "first", []),
    "c9": (composites.c9_first_exit_trigger, "entered", []),
    "c26": (composites.c26_first_trigger_per_variant, "first", []),
    "w26": (tape.w26_flow_imbalance, "t", []),
    "w21": (lambda t: tape.w21_crash_trigger(t).where("variant <> 'demand'"), "first", ["buyers"]),
    "w29": (tape.w29_silence_then_burst, "first", []),
    "w23": (tape.w23_wash_flags, "flagged_at", []),
}


@pytest.mark.parametrize("name", list(TRIGGERS))
@pytest.mark.parametrize("day", ["1995-03-01", "1996-07-15"])
def test_no_trigger_sees_ahead(spark, name, day):
    plan, at, later = TRIGGERS[name]
    micros = int(spark.sql(f"SELECT unix_micros(timestamp'{day} 00:00:00')").first()[0])
    whole, part = plan(Tables(spark, SF)).drop(*later), plan(Cut(spark, day)).drop(*later)
    keep = F.col(at) < micros - 86_400_000_000 * (name == "c26")
    got, want = (sorted(map(str, df.where(keep).collect())) for df in (part, whole))
    assert got == want


def test_all_are_registered():
    assert {"c8_hot_trigger", "c9_first_exit_trigger", "c26_first_trigger_per_variant", "w21_crash_trigger"} <= set(plans.QUERIES)
