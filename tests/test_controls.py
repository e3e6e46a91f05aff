"""Every event gets a control."""

import datetime as dt
from collections import Counter

from conftest import SMALL

import __spark_entry__ as entry
from enanto.operators import spatial
from enanto.session import table

NOON, MAY = dt.datetime(2001, 1, 1, 12), dt.datetime(2001, 5, 1, 3)
CASES = "case_id string, domain string, case_type string, lat0 double, lon0 double, onset_time timestamp_ntz"


def test_events_beyond_the_controls_and_all_tiers(spark):
    events = [(f"storm_{i}", "d", "storm", 10.0, 60.0, NOON) for i in range(7)] + [("storm_x", "alone", "near_storm", 5.0, 350.0, NOON), ("storm_y", "alone", "storm", None, None, None)]
    controls = [("c_exact", "d", "control", 10.0, 60.0, None), ("c_beside", "d", "control", 10.0, 120.0, NOON), ("c_far", "d", "control", 70.0, 240.0, MAY)]
    c = spark.createDataFrame(events + controls, CASES)
    s = spark.createDataFrame([("c_exact", NOON), ("c_exact", MAY)], "case_id string, t timestamp_ntz")
    got = {r.case_id: r for r in spatial.controls_for_all(c, s).collect()}
    assert set(got) == {e[0] for e in events}
    mine = [r for r in got.values() if r.control_id.startswith("c_")]
    assert Counter((r.control_id, r.match_quality) for r in mine) == {("c_exact", "tier_a_exact"): 3, ("c_beside", "tier_b_lon_adjacent"): 3, ("c_far", "tier_c_lead_only"): 1}
    assert (got["storm_x"].control_id, got["storm_x"].lon0, got["storm_x"].match_quality) == ("ctrl_x", 290.0, "offset")
    assert got["storm_y"].control_id == "ctrl_y" and got["storm_y"].lon0 is None


def test_reuse_is_even(spark):
    data = [(f"storm_{i}", "d", "storm", 10.0, 60.0, NOON) for i in range(20)] + [(f"c{i}", "d", "control", 10.0, 60.0, NOON) for i in range(4)]
    r = spatial.controls_for_all(spark.createDataFrame(data, CASES), spark.createDataFrame([], "case_id string, t timestamp_ntz")).collect()
    assert len(r) == 20 and set(Counter(x.control_id for x in r).values()) == {5}


def test_registered_for_every_event(spark):
    n = table(spark, SMALL, "cases").where("case_id is not null and case_type in ('storm', 'near_storm')").count()
    got = entry.queries()["controls_for_all"](spark, SMALL).collect()
    assert len(got) == n == len({r.case_id for r in got})
