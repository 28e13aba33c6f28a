"""Plans that must hold at scale."""

import pytest

import __spark_entry__ as entry
from packetloom.operators import logs

SF_DIR = "/root/testdata/sf0.001"
PYTHON = {
    "c4_variant_scan", "c5_signatures_payloads", "c5_signatures_pages", "c5_signatures_conversations",
    "c6_content_gate", "c6_content_reasons", "f10_byte_entropy", "m3_isolation",
}
# These start jobs of their own (training, streams, alert chains); what they return is a table.
EAGER = {"m13_m14_retrain", "r10_score_packets", "m2_forest"}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def names():
    return sorted(n for n in entry.queries() if n not in EAGER and not n.endswith("_stream") and n[:2] not in ("a3", "a4", "s8"))


@pytest.mark.parametrize("name", names())
def test_no_pairing_and_no_row_python(spark, name):
    plan = plan_of(entry.queries()[name](spark, SF_DIR))
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "BatchEvalPython" not in plan
    assert ("ArrowEvalPython" in plan) == (name in PYTHON)


def test_search_pushes_filters_and_columns(spark, tmp_path):
    df = spark.read.parquet(f"{SF_DIR}/events.parquet").selectExpr(
        "event_id AS id", "value AS ts_sec", "event_type AS src_ip", "event_type AS dst_ip", "props")
    df.write.parquet(str(tmp_path / "t"))
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    found = logs.search(spark.read.parquet(str(tmp_path / "t")), src_ip="click", start_time=5, end_time=9)
    plan = plan_of(logs.newest(found.select("id", "ts_sec"), 10))
    assert "EqualTo(src_ip,click)" in plan and "GreaterThanOrEqual(ts_sec,5.0)" in plan
    assert "TakeOrderedAndProject" in plan and "props" not in plan
