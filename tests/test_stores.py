"""Stored verdicts: the text index and the kept aggregates against whole scans."""

import random

import pytest
from pyspark.sql import functions as F

from packetloom.operators import logs, rollups
from packetloom.sources import search_index

ROWS = "id bigint, ts_sec double, src_ip string, classification string, ai_score double, risk_score double, url string, reasons array<string>"


def verdicts(seed, n, start=1_700_000_000):
    rng = random.Random(seed)
    kinds = ["safe", "Suspicious", "dangerous", "odd", None]
    return [
        (k, None if k % 97 == 0 else start + rng.random() * 3 * 86_400, rng.choice([None, "", f"10.0.0.{rng.randrange(250)}"]),
         rng.choice(kinds), rng.choice([None, rng.random()]), rng.choice([None, rng.random()]),
         f"http://h{k * 12 // n}.example/\"a\\{k}é", ["x", f"r{k % 5}"])
        for k in range(n)
    ]


def test_indexed_search_equals_the_scan(spark, tmp_path):
    table, index = str(tmp_path / "logs"), str(tmp_path / "index")
    rows = spark.createDataFrame(verdicts(1, 600), ROWS)
    rows.where("id < 300").repartitionByRange(6, "id").write.partitionBy("classification").parquet(table)
    assert search_index.candidate_files(spark, table, index, "h1.ex")  # no index yet: every file
    first = search_index.add_files(spark, table, index)
    assert first > 6 and search_index.add_files(spark, table, index) == 0
    rows.where("id >= 300 AND id < 500").repartitionByRange(6, "id").write.mode("append").partitionBy("classification").parquet(table)
    assert search_index.add_files(spark, table, index) > 0
    rows.where("id >= 500").write.mode("append").partitionBy("classification").parquet(table)  # not indexed
    whole = spark.read.parquet(table)
    for q in ("h1.example", "H7.Example", " é ", "a\\\\", "zz", "no such text", "dangerous", "\"ts_sec\":null", "h11.", ""):
        got = search_index.free_text(spark, table, index, q)
        assert got.columns == whole.columns
        assert sorted(r.id for r in got.collect()) == sorted(r.id for r in logs.free_text(whole, q).collect())
    read, every = (len(search_index.candidate_files(spark, table, index, q)) for q in ("h1.example", "x"))
    assert read < every / 2
    part = '"a\\3'
    found = logs.search(search_index.rows_with(spark, table, index, part), url=part)
    assert sorted(r.id for r in found.collect()) == sorted(r.id for r in logs.search(whole, url=part).collect()) != []


@pytest.mark.parametrize("start, end", [
    (1_700_000_000.5, 1_700_200_000.25), (1_699_999_980, 1_700_086_400), (1_700_000_040.0, 1_700_000_100.0),
    (1_700_000_041.0, 1_700_000_043.0), (1_600_000_000.0, 1_800_000_000.0), (1_700_000_050.0, 1_700_000_110.0), (5.0, 4.0),
])
def test_kept_levels_equal_the_rows(spark, tmp_path, start, end):
    rows = spark.createDataFrame(verdicts(2, 900), ROWS)
    for batch in range(3):
        rollups.add_batch(rows.where(F.col("id") * 7919 % 3 == batch), str(tmp_path / "kept"), batch)
    rollups.add_batch(rows.where("id * 7919 % 3 = 1"), str(tmp_path / "kept"), 1)  # runs again
    want = logs.window_totals(rows, start, end).head()
    for path in (str(tmp_path / "kept"), rollups.compact(spark, str(tmp_path / "kept"))):
        got = rollups.window_totals(spark, path, rows, start, end).head()
        assert [got[c] for c in ("total", "safe", "suspicious", "dangerous")] == [want[c] for c in ("total", "safe", "suspicious", "dangerous")]
        assert abs(got.attackers_estimate - want.unique_attackers) <= 3 * 0.0163 * want.unique_attackers
        if 0 < end - start < 300_000:
            series = rollups.timeseries(spark, path, rows, start, end)
            assert sorted(series.collect()) == sorted(logs.timeseries(rows, start, end).drop("has_data").collect())
    assert rollups.counters(spark, path).head().total == 900


def test_sketches_stay_within_their_bound(spark, tmp_path):
    """Many attackers over many batches: three standard errors hold."""
    rows = spark.range(60_000).select(
        "id", (F.lit(1_700_000_000.0) + F.col("id") % 7200).alias("ts_sec"), F.concat(F.lit("a"), F.col("id") % 20_000).alias("src_ip"),
        F.lit("dangerous").alias("classification"), F.lit(None).cast("double").alias("ai_score"), F.lit(0.5).alias("risk_score"),
    )
    for batch in range(2):
        rollups.add_batch(rows.where(F.col("id") % 2 == batch), str(tmp_path / "kept"), batch)
    got = rollups.window_totals(spark, str(tmp_path / "kept"), rows, 1_700_000_000.0, 1_700_007_200.0).head()
    assert got.total == 60_000 and abs(got.attackers_estimate - 20_000) <= 3 * 0.0163 * 20_000


def test_ranges_are_covered_once():
    rng = random.Random(4)
    for _ in range(300):
        start = rng.randrange(0, 5_000) * 60
        end = start + rng.randrange(0, 6_000) * 60
        ranges = rollups._cover(start, end)
        assert sum(high - low for _, low, high in ranges) == end - start and len(ranges) <= 5
        assert all(low % rollups.LEVELS[level] == high % rollups.LEVELS[level] == 0 for level, low, high in ranges)
        edges = sorted((low, high) for _, low, high in ranges)
        assert all(a[1] == b[0] for a, b in zip(edges, edges[1:], strict=False))


def test_trigrams_of_uneven_files(spark, monkeypatch):
    """All trigrams of each file and none across two texts; one file with most rows is dealt over several tasks."""
    rng = random.Random(8)
    rows = [("big", "".join(rng.choice("abé\U0001f600\"\0") for _ in range(rng.randrange(12)))) for _ in range(900)]
    rows += [("one", "xyz"), ("two", "x"), ("two", "yz"), ("two", ""), ("none", "ab")]
    want = {(f, t[k : k + 3]) for f, t in rows for k in range(len(t) - 2)}
    dealt = spark.createDataFrame(rows, "file string, text string").coalesce(1)
    got = [(r.file, r.gram) for r in search_index._trigrams(dealt).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    plan = search_index._trigrams(dealt)._jdf.queryExecution().toString()
    assert "explode" not in plan and "hashpartitioning(file" in plan
    monkeypatch.setattr(search_index, "HELD", 5)
    assert {(r.file, r.gram) for r in search_index._trigrams(dealt).collect()} == want
