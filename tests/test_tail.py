"""Growing logs followed by byte positions."""

import pytest
from pyspark.sql import functions as F

from packetloom.sources import tail

HEAD = "#separator \\x09\n#fields\tts\tuid\n"


@pytest.fixture
def log(tmp_path):
    (tmp_path / "logs").mkdir()
    return tmp_path / "logs" / "conn.log"


def read(reader, start):
    """All (position, value) between an offset and the latest one, with the ranges they came by."""
    end = reader.latestOffset()
    ranges = reader.partitions(start, end)
    rows = [(p, v) for r in ranges for b in reader.read(r) for p, v in zip(b["position"].to_pylist(), b["value"].to_pylist(), strict=True)]
    return rows, end, ranges


@pytest.mark.parametrize("range_bytes", [1, 3, 7, 50, 10_000])
def test_ranges_cut_nowhere(log, range_bytes):
    lines = [f"{k}\t{'x' * (k % 11)}" for k in range(60)]
    lines[7] = "# a comment\tinside"
    log.write_text(HEAD + "\n".join(lines[:30]) + "\n\n" + "\r\n".join(lines[30:]) + "\n")
    reader = tail.SensorLogReader({"path": str(log.parent), "rangeBytes": str(range_bytes)})
    rows, _, ranges = read(reader, reader.initialOffset())
    assert [v for _, v in rows] == [v for v in lines if not v.startswith("#")]
    raw = log.read_bytes()
    assert all(raw[p:].decode().startswith(v) for p, v in rows)
    assert max(r.end - r.begin for r in ranges) <= range_bytes


def test_only_what_is_new_and_whole(log):
    reader = tail.SensorLogReader({"path": str(log.parent)})
    log.write_text("#separator \\x09\n")
    rows, at, _ = read(reader, reader.initialOffset())
    assert rows == [] and at == {"files": {}}
    log.write_text(HEAD + "1\ta\n2\t")
    rows, at, _ = read(reader, at)
    assert [v for _, v in rows] == ["1\ta"]
    with log.open("a") as out:
        out.write("b\n3\tc\n")
    rows, at, ranges = read(reader, at)
    assert [v for _, v in rows] == ["2\tb", "3\tc"] and ranges[0].begin == len(HEAD) + 4
    assert read(reader, at)[0] == [] and reader.partitions(at, at) == []
    log.write_text(HEAD + "4\td\n")  # cut
    rows, at, _ = read(reader, at)
    assert [v for _, v in rows] == ["4\td"]
    log.write_text(HEAD + "5\te\n6\tf\n7\tg\n")  # rewritten beyond where reading ended, under the same header
    rows, at, _ = read(reader, at)
    assert [v for _, v in rows] == ["5\te", "6\tf", "7\tg"]
    log.write_text("#fields\tuid\tts\nz\t8\n" + "y\t9\n" * 9)  # another header
    rows, at, ranges = read(reader, at)
    assert len(rows) == 10 and {r.fields for r in ranges} == {"uid\tts"}
    log.unlink()
    assert read(reader, at)[0] == []


def test_lines_cut_between_offset_and_read_are_gone(log):
    reader = tail.SensorLogReader({"path": str(log)})
    log.write_text(HEAD + "1\ta\n2\tb\n")
    end = reader.latestOffset()
    log.write_text(HEAD + "9\tz\n")
    assert [list(reader.read(r)) for r in reader.partitions({"files": {}}, end)] == [[]]
    assert [v for _, v in read(reader, end)[0]] == ["9\tz"]


def test_a_large_log_is_many_tasks(spark, log, tmp_path):
    log.write_text(HEAD + "".join(f"{k}\tu{k}\n" for k in range(20_000)))
    (log.parent / "other.txt").write_text("1\t2\n")
    lines = tail.follow(spark, str(log.parent), "*.log", 20_000)

    def run():
        lines.withColumn("task", F.spark_partition_id()).writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
            "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(str(tmp_path / "out"))

    first = run()
    assert first.select("value").distinct().count() == first.count() == 20_000 and first.select("task").distinct().count() > 5
    with log.open("a") as out:
        out.write("x\ty\n")
    assert run().count() == 20_001
