"""Paths, payloads and hints of the sources."""

import pytest

from policylake.operators import selection
from policylake.plans import catalog
from policylake.sources import telemetry


def test_a_hint_may_name_an_action_that_no_row_shows():
    assert selection.checked_hints({"proportional_fair:prb=4": 0.2}, selection.action_names()) == {"proportional_fair:prb=4": 0.2}
    with pytest.raises(ValueError):
        selection.checked_hints({"proportional_fair:prb=276": 0.2}, selection.action_names())


def test_hints_query_runs_without_some_hinted_action(spark, tmp_path):
    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    # scheduler code 1 only: no proportional_fair and no round_robin action is logged
    li.where("l_linenumber % 3 = 1").write.parquet(f"{tmp_path}/lineitem.parquet")
    rows = catalog.QUERIES["p25_bounded_hints"](spark, str(tmp_path)).collect()
    assert rows and {r["hint"] for r in rows} <= {0.0, 0.05}


def test_path_filter_reads_each_path_once(spark):
    plan = catalog.QUERIES["s5_path_filter_completeness"](spark, "/root/testdata/sf0.001")
    read = plan.inputFiles()  # the distinct paths
    assert read and not any("lineitem" in f for f in read)
    assert plan.collect()[0]["files"] > 0


def test_aliases_are_searched_in_one_text_a_row(spark):
    texts = [
        '{"x": 7, "\\u0001rsrp": -80, "RSRP": -70, "cells": [{"DL_Brate": 3, "dl_prb": 40}]}',
        '{"a": {"sinr": 9}, "cqi": 5, "nof_ues": 4}', '{"dl_brate": NaN, "dl_bitrate": 6}', "{}", "[1", None,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, payload string")
    got = {r["id"]: r for r in telemetry.map_metrics(telemetry.with_entries(df, "payload").where("entries is not null")).collect()}
    assert sorted(got) == [0, 1, 2, 3]
    assert (got[0]["rsrp_dbm"], got[0]["downlink_mbps"], got[0]["prb_utilization"]) == (-80.0, 3.0, 0.4)
    assert (got[1]["sinr_db"], got[1]["active_users"]) == (9.0, 4)
    assert got[2]["downlink_mbps"] == 6.0 and got[3]["telemetry_completeness"] == 0.0
    plan = telemetry.map_metrics(df.withColumn("entries", telemetry.F.expr("cast(null as array<struct<path: string, value: double>>)")))
    assert plan._jdf.queryExecution().analyzed().toString().count("lambdafunction") == 1
