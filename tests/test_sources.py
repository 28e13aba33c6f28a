"""Files in, tables out: round trips."""

import pytest
from pyspark.sql import functions as F

from packetloom.operators import flows, maintain
from packetloom.sources import lists, tables, training


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def cic_csv(rows, extra=""):
    head = ",".join(f" {c}" for c in flows.CSV_COLUMNS.values()) + f"{extra}, Label\n"
    return head + "".join(rows)


def test_csv_folder(spark, tmp_path):
    row = ",".join(["1"] * 17)
    write(tmp_path / "in/b.csv", cic_csv([row + ",DDoS\n", ",".join(["Infinity"] * 17) + ",BENIGN\n"]))
    write(tmp_path / "in/a.csv", cic_csv([row + ", benign\n"]))
    df = training.read_cic(spark, str(tmp_path / "in"))
    assert sorted(r.label for r in df.collect()) == [0, 0, 1]
    assert df.where("label = 0").agg(F.min("destination_port")).head()[0] == 0.0
    strict = training.read_cic(spark, str(tmp_path / "in"), strict=True)
    assert sorted(r.label for r in strict.collect()) == [0, 1, 1]
    other = write(tmp_path / "c.csv", cic_csv([row + ",17,BENIGN\n"], ", Protocol"))
    both = training.read_cic(spark, [str(tmp_path / "in"), other])
    assert both.count() == 4 and both.where("protocol_code = 2").count() == 1


def test_missing_columns_are_named(spark, tmp_path):
    path = write(tmp_path / "x.csv", "Label,Flow Duration\nBENIGN,1\n")
    with pytest.raises(ValueError, match="Destination Port, Total Fwd Packets"):
        training.read_cic(spark, path)


def test_vectors(spark):
    raw = ['[1, 2.5]', '[1, NaN, -Infinity, null]', '["3", 4]', '["x", 1]', '[]', '', None, '[1,', '{"a": 1}', '7e-05']
    df = spark.createDataFrame([(r, l) for r, l in zip(raw, ["safe", "0", "Benign", "x", "", "a", "b", "c", "d", "e"])],
                               "features_json string, label string")
    rows = [r.features for r in training.read_training(df).collect()]
    assert rows == [[1.0, 2.5], [1.0, 0.0, 0.0, 0.0], [3.0, 4.0]]
    assert training.parse_vectors(df).where("skipped").count() == 7
    assert training.read_training(df, dim=4).count() == 1
    assert {r.label for r in training.read_training(df.withColumnRenamed("features_json", "features")).collect()} == {0}


def test_choose_training(spark):
    some = spark.createDataFrame([([1.0], 0)], "features array<double>, label int")
    none = some.limit(0)
    pick = training.choose_training
    assert pick(csv=some, stores={"a": some}).head().source == "csv"
    both = pick(stores={"a": some, "b": some, "c": none})
    assert both.count() == 2 and both.head().source == "a+b"
    assert pick(stores={"a": none}, fallback=some).head().source == "csv-fallback"
    assert pick(stores={"a": none}).count() == 0


def test_blocklist_and_zeek_files(spark, tmp_path):
    path = write(tmp_path / "block.txt", "# x\n1.1.1.1\n\n 2.2.2.0/24 # y\n1.1.1.1\n")
    assert sorted(r.value for r in lists.read_blocklist(spark, path).collect()) == ["1.1.1.1", "2.2.2.0/24"]
    folder = tmp_path / "zeek"
    write(folder / "conn.log", "#separator \\x09\n#fields\tts\tid.orig_h\tid.resp_h\n1\ta\tb\nbad line\n\n2\tc\t-\n")
    df = lists.read_zeek(spark, str(folder))
    assert df.columns == ["ts", "orig_h", "resp_h"] and df.count() == 2

    def follow():
        stream = lists.read_zeek(spark, str(folder), streaming=True)
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
            "checkpointLocation", str(tmp_path / "cp")
        ).trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(str(tmp_path / "out")).count()

    assert follow() == 2
    write(folder / "conn2.log", "3\td\te\n")
    assert follow() == 3
    write(folder / "conn3.log", "#fields\tid.resp_h\tts\tuid\ny\t9\tu\n")
    assert follow() == 4
    both = lists.read_zeek(spark, str(folder)).where("ts = '9'").collect()
    assert [(r.ts, r.resp_h, r.orig_h, r.uid) for r in both] == [("9", "y", None, "u")]


def test_csv_files_with_other_headers(spark, tmp_path):
    write(tmp_path / "in/a.csv", "A,B\n1,2\n")
    write(tmp_path / "in/b.csv", "B, A\n2,1\n")
    write(tmp_path / "in/c.csv", "A,C\n1,3\n")
    rows = training.read_csv_folder(spark, str(tmp_path / "in")).collect()
    assert sorted((r.A, r.B, r.C) for r in rows if r.C is None) == [("1", "2", None)] * 2
    assert [(r.A, r.B, r.C) for r in rows if r.C] == [("1", None, "3")]


def test_newest_notices_by_time(spark):
    from packetloom.operators import zeek

    rows = [(float(k), "-", "1.1.1.1", "Scan::Port" if k < 5 else "quiet") for k in range(60)]
    log = spark.createDataFrame(rows, "ts double, uid string, src string, note string").withColumn("msg", F.lit(""))
    assert zeek.notices(log, cap=50).head().score == 0.4
    whole = zeek.notices(log).head()
    assert whole.score == 0.85 and whole.notices == 60 and whole.signals == ["zeek_notice_scan::port"]


@pytest.fixture()
def verdicts(spark):
    day = 86_400.0
    return spark.range(40).select(
        "id", (F.col("id") * day / 4 + 1).alias("ts_sec"),
        F.concat(F.lit("1.1.1."), F.col("id") % 3).alias("src_ip"), F.lit("u").alias("url"),
        F.element_at(F.array(*[F.lit(c) for c in ("safe", "dangerous", "suspicious", None)]), (F.col("id") % 4 + 1).cast("int")).alias("classification"),
        F.lit(0.5).alias("risk_score"), F.array(F.lit("r")).alias("reasons"),
        F.array(F.lit(1.0)).alias("features"),
    )


def test_log_rows(spark, verdicts, tmp_path):
    path = str(tmp_path / "logs")
    tables.write_dated(tables.log_rows(verdicts), path)
    stored = spark.read.parquet(path)
    assert stored.count() == 40 and stored.select("event_date").distinct().count() == 10
    assert stored.where("classification = 'safe'").count() == 20
    assert tables.training_rows(verdicts).where("label != 'safe'").count() >= 20
    kept = maintain.retain(stored, as_of=10 * 86_400.0)
    assert "PartitionFilters: [isnotnull(event_date" in kept._jdf.queryExecution().executedPlan().toString()


def test_sinks_refuse_missing_columns(spark, verdicts):
    for sink, lost in ((tables.log_rows, "ts_sec"), (tables.log_rows, "risk_score"), (tables.history_rows, "id"), (tables.training_rows, "features")):
        with pytest.raises(ValueError, match=lost):
            sink(verdicts.drop(lost))


def test_batch_runs_again(spark, verdicts, tmp_path):
    path = str(tmp_path / "logs")
    for batch, low in ((0, 0), (1, 20), (1, 20)):
        tables.write_batch(tables.log_rows(verdicts.where(F.col("id").between(low, low + 19))), path, batch)
    assert [r.id for r in spark.read.parquet(path).orderBy("id").collect()] == list(range(40))


def test_purge(spark, verdicts):
    spark.sql("DROP TABLE IF EXISTS purge_logs")
    tables.log_rows(verdicts).write.partitionBy("event_date").saveAsTable("purge_logs")
    assert tables.purge(spark, "purge_logs", as_of=10 * 86_400.0, days=7.4) == 11
    left = [r.id for r in spark.table("purge_logs").orderBy("id").collect()]
    assert left == list(range(11, 40))
    assert tables.purge(spark, "purge_logs", as_of=10 * 86_400.0, days=7.4) == 0


def test_snapshot(spark, verdicts, tmp_path):
    path = str(tmp_path / "stats")
    tables.write_snapshot(spark, maintain.snapshot(verdicts.limit(3)), path)
    tables.write_snapshot(spark, maintain.snapshot(verdicts), path)
    row = tables.read_snapshot(spark, path).head()
    assert (row.total, row.safe, row.dangerous, row.unique_attackers) == (40, 20, 10, 3)
    assert maintain.distinct_counts(verdicts, approximate=True).head().dangerous_urls == 1


def test_purge_of_streamed_batches(spark, verdicts, tmp_path, monkeypatch):
    path = str(tmp_path / "logs")
    rows = tables.log_rows(verdicts)

    def fill():
        for batch in range(4):
            tables.write_batch(rows.where(F.col("id") % 4 == batch), path, batch)

    def left():
        return sorted(r.id for r in spark.read.parquet(path).collect())

    fill()
    held = tables.purge_batches(spark, path, as_of=10 * 86_400.0, days=7.4)
    assert held == 11 and left() == list(range(11, 40))
    assert tables.purge_batches(spark, path, as_of=10 * 86_400.0, days=7.4) == 0
    fill()
    # A failure after the day of the cutoff was rewritten: nothing that stays is lost, and a second call ends the work.
    seen = []
    monkeypatch.setattr(tables, "sorted", lambda names: seen.extend(names) or (_ for _ in ()).throw(OSError("lost")), raising=False)
    with pytest.raises(OSError):
        tables.purge_batches(spark, path, as_of=10 * 86_400.0, days=7.4)
    monkeypatch.undo()
    assert seen and set(range(11, 40)) <= set(left())
    tables.purge_batches(spark, path, as_of=10 * 86_400.0, days=7.4)
    assert left() == list(range(11, 40))
    assert tables.purge_batches(spark, path, as_of=10**9, days=1) == 29
