"""Deep pages by ranges of the sort order, and the newest rows kept up batch by batch."""

import random

import pytest
from pyspark.sql import functions as F

from packetloom.operators import logs
from packetloom.sources import page_index, recent

ROWS = "id bigint, ts_sec double, src_ip string, score double"


def rows_of(spark, n=2_000, seed=5):
    """A third of all rows share one source; some have no source or no time."""
    rng = random.Random(seed)
    made = []
    for k in range(n):
        source = "10.0.0.1" if k % 3 == 0 else rng.choice([None, "", "é", f"10.0.1.{rng.randrange(40)}"])
        made.append((k, rng.choice([None, float(rng.randrange(300))]), source, rng.random()))
    rng.shuffle(made)
    return spark.createDataFrame(made, ROWS)


@pytest.mark.parametrize("sort, order", [("id", "desc"), ("src_ip", "asc"), ("src_ip", "desc"), ("ts_sec", "desc"), ("score", "asc")])
def test_pages_equal_the_whole_sort(spark, tmp_path, sort, order):
    rows, path = rows_of(spark), str(tmp_path / "pages")
    assert page_index.build(rows, path, sort, order, range_rows=150) == page_index.total(spark, path) == 2_000
    for number, size in ((1, 25), (40, 25), (80, 25), (7, 300), (81, 25), (1, 5_000), (0, 7)):
        got = page_index.page(spark, path, number, size)
        want = logs.offset_page(rows, sort=sort, order=order, page=number, page_size=size)
        assert got.columns == want.columns
        assert got.collect() == want.collect()


def test_a_deep_page_opens_one_or_two_ranges(spark, tmp_path):
    """Also where one value fills many ranges."""
    rows, path = rows_of(spark), str(tmp_path / "pages")
    page_index.build(rows, path, "src_ip", "asc", range_rows=100)
    every = spark.read.parquet(f"{path}/sizes").collect()
    assert len(every) >= 15 and max(r.n for r in every) <= 300
    for number in range(1, 81):
        assert 1 <= len(page_index.ranges(spark, path, (number - 1) * 25, 25)) <= 2
    assert len(page_index.page(spark, path, 70).inputFiles()) <= 2


def test_empty_table_and_clashing_column(spark, tmp_path):
    none = rows_of(spark).where("id < 0")
    assert page_index.build(none, str(tmp_path / "none")) == 0
    got = page_index.page(spark, str(tmp_path / "none"), 3)
    assert got.columns == none.columns and got.collect() == []
    with pytest.raises(ValueError):
        page_index.build(none.withColumn(page_index.RANGE, F.lit(1)), str(tmp_path / "clash"))


def test_newest_rows_after_every_batch(spark, tmp_path):
    """Batches out of order, one empty, one run again; few versions stay."""
    rows, path = rows_of(spark), str(tmp_path / "recent")
    with pytest.raises(ValueError):
        recent.read(spark, path)
    seen = rows.where("id < 0")
    for batch in range(7):
        part = rows.where(F.lit(False) if batch == 2 else F.col("id") * 7919 % 7 == batch)
        seen = seen.unionByName(part)
        for _ in range(2 if batch == 4 else 1):
            recent.add_batch(part, path, batch, limit=120)
        assert logs.newest(recent.read(spark, path), 500).collect() == logs.newest(seen, 120).collect()
    assert len(recent.versions(spark, path)) <= recent.STAY + 2


def test_newest_rows_of_a_stream(spark, tmp_path):
    rows, path = rows_of(spark, 600), str(tmp_path / "recent")
    for k in range(3):
        rows.where(F.col("id") % 3 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    sink = recent.follow(stream, path, limit=50).option("checkpointLocation", str(tmp_path / "state"))
    run = sink.trigger(availableNow=True).start()
    assert run.awaitTermination(120) and run.exception() is None
    assert len(recent.versions(spark, path)) == 3
    assert logs.newest(recent.read(spark, path), 50).collect() == logs.newest(rows, 50).collect()


def test_many_ranges_few_files(spark, tmp_path):
    """Ranges are places in files: a hundred ranges are no hundred tasks and folders."""
    rows, path = rows_of(spark), str(tmp_path / "pages")
    page_index.build(rows, path, "ts_sec", "desc", range_rows=20)
    every = spark.read.parquet(f"{path}/sizes").orderBy("before").collect()
    assert len(every) >= 100 and max(r.n for r in every) <= 20 and sum(r.n for r in every) == 2_000
    assert [r.before for r in every] == [sum(r.n for r in every[:k]) for k in range(len(every))]
    assert len(spark.read.parquet(f"{path}/rows").inputFiles()) <= 8
    for number, size in ((1, 25), (41, 25), (3, 500), (81, 25)):
        want = logs.offset_page(rows, sort="ts_sec", order="desc", page=number, page_size=size)
        assert page_index.page(spark, path, number, size).collect() == want.collect()
    with pytest.raises(ValueError):
        page_index.build(rows.withColumn(page_index.PLACE, F.lit(1)), str(tmp_path / "clash"))
