import pytest
from pyspark.sql import functions as F

from lexiloom.operators import sync as S
from lexiloom.streaming.changes import follow, latest_changes

SCHEMA = "source_id string, content_fp string, meta_fp string"


def test_classes(spark):
    now = spark.createDataFrame([("a", "1", "1"), ("b", "2", "1"), ("c", "1", "2"), ("d", "1", "1")], SCHEMA)
    old = spark.createDataFrame([("b", "1", "1"), ("c", "1", "1"), ("d", "1", "1"), ("e", "1", "1"), ("f", "1", "1")], SCHEMA)
    away = spark.createDataFrame([("f",)], "source_id string")
    got = {r[0]: r[1] for r in S.diff(now, old, missing=away).collect()}
    assert got == {"a": S.NEW, "b": S.CHANGED, "c": S.META, "d": S.SAME, "e": S.GONE, "f": S.MISSING}
    assert {r[0]: r[1] for r in S.diff(now, old, sweep=False).collect()}["e"] == S.SAME
    assert {r[0]: r[1] for r in S.diff(now, old, force=F.lit(True)).collect()}["d"] == S.CHANGED


def build(failing=()):
    return lambda work: work.select("source_id", F.lit(0).alias("seq"), F.concat("content_fp", F.lit("-text")).alias("chunk"), F.col("meta_fp").alias("meta"), F.when(F.col("source_id").isin(*failing), "broken").alias("error"))


def stored(store):
    return {(r["source_id"], r["chunk"], r["meta"]) for r in store.read("chunks").collect()}


def test_sync_retries_and_replaces(spark, tmp_path):
    store = S.Snapshots(spark, str(tmp_path / "store"), buckets=4)
    one = spark.createDataFrame([("a", "1", "1"), ("b", "1", "1")], SCHEMA)
    assert S.sync(store, one, build(["b"])) == {S.NEW: 2}
    assert stored(store) == {("a", "1-text", "1")}
    two = spark.createDataFrame([("a", "2", "1"), ("b", "1", "1")], SCHEMA)
    assert S.sync(store, two, build()) == {S.CHANGED: 1, S.NEW: 1}
    assert stored(store) == {("a", "2-text", "1"), ("b", "1-text", "1")}
    assert S.sync(store, two.where("source_id = 'a'"), build()) == {S.SAME: 1, S.GONE: 1}
    assert stored(store) == {("a", "2-text", "1")}


def test_sync_applies_metadata(spark, tmp_path):
    """A source whose metadata alone changed gets its new metadata and keeps its stored text; then it is up to date."""
    store = S.Snapshots(spark, str(tmp_path / "store"), buckets=4)
    S.sync(store, spark.createDataFrame([("a", "1", "m1"), ("b", "1", "m1")], SCHEMA), build())
    changed = spark.createDataFrame([("a", "1", "m2"), ("b", "1", "m1")], SCHEMA)
    other_text = lambda work: build()(work).withColumn("chunk", F.lit("not to be stored"))
    assert S.sync(store, changed, other_text) == {S.META: 1, S.SAME: 1}
    assert stored(store) == {("a", "1-text", "m2"), ("b", "1-text", "m1")}
    assert S.sync(store, changed, build()) == {S.SAME: 2}


def test_a_writer_that_dies_leaves_the_last_version(spark, tmp_path, monkeypatch):
    store = S.Snapshots(spark, str(tmp_path / "store"), buckets=4)
    one = spark.createDataFrame([("a", "1", "1"), ("b", "1", "1")], SCHEMA)
    S.sync(store, one, build())

    class Dies:
        def __init__(self, fs):
            self.fs = fs

        def __getattr__(self, name):
            return getattr(self.fs, name)

        def rename(self, *_):
            raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(store, "_fs", Dies(store._fs))
        with pytest.raises(RuntimeError):
            S.sync(store, spark.createDataFrame([("a", "2", "1")], SCHEMA), build())
    assert stored(store) == {("a", "1-text", "1"), ("b", "1-text", "1")} and store.version()[0] == 1
    late = S.Snapshots(spark, str(tmp_path / "store"), buckets=4)
    monkeypatch.setattr(late, "version", lambda: (0, {}))  # read before the other writer's version
    with pytest.raises(OSError):
        S.sync(late, one, build())


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    store = S.Snapshots(spark, str(tmp_path / "store"), buckets=16)
    rows = [(f"s{i}", "1", "1") for i in range(60)]
    S.sync(store, spark.createDataFrame(rows, SCHEMA), build())
    before = store.version()[1]["chunks"]["folders"]
    S.sync(store, spark.createDataFrame([("s0", "2", "1"), *rows[1:]], SCHEMA), build())
    after = store.version()[1]["chunks"]["folders"]
    assert sum(before[b] != after[b] for b in before) == 1 and len(stored(store)) == 60
    store.clean(1)
    assert len(stored(store)) == 60 and store.version()[0] == 2


def test_new_chunker_version_changes_fingerprints(spark):
    one = spark.range(1).select(*[S.content_fingerprint(F.lit("text"), version=v).alias(f"v{v}") for v in (1, 2)]).first()
    assert one[0] != one[1] and len(one[0]) == 16


def test_stream_follows_files(spark, tmp_path):
    store = S.Snapshots(spark, str(tmp_path / "chunks"), buckets=4)
    source, schema = str(tmp_path / "in"), "source_id string, chunk string, ts int"
    for k in range(2):
        spark.createDataFrame([("a", "stale", 0), ("a", f"v{k}", 1), (f"b{k}", "x", 0)], schema).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        follow(stream, store, lambda rows: rows, str(tmp_path / "check")).awaitTermination()
    assert {tuple(r)[:2] for r in store.read("chunks").collect()} == {("a", "v1"), ("b0", "x"), ("b1", "x")}


def test_windows_of_changes(spark, tmp_path):
    rows = spark.sql("select timestamp_ntz'2024-01-01 10:00:00' ts, 'k' key, 'f1' fp union all select timestamp_ntz'2024-01-01 11:00:00', 'k', 'f2'")
    rows.write.parquet(str(tmp_path / "events"))
    stream = latest_changes(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "events")))
    stream.writeStream.outputMode("complete").format("memory").queryName("changes_test").trigger(availableNow=True).start().awaitTermination()
    assert [(r["changes"], r["last_fp"]) for r in spark.table("changes_test").collect()] == [(2, "f2")]
