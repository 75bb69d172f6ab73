"""Incremental sync: what changed, and how the stored tables follow; snapshots that readers switch to at once."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import fingerprint

#: Changes with every change of what chunks are made of a text.
CHUNKER_VERSION = 1
NEW, CHANGED, META, GONE, MISSING, SAME = "new", "changed", "meta_only", "gone", "missing", "unchanged"


def diff(current: DataFrame, known: DataFrame, sweep: bool = True, force: Column | None = None, missing: DataFrame | None = None) -> DataFrame:
    """(source_id, class) of every source, from (source_id, content_fp, meta_fp) now and as stored.

    Exactly one class each: a forced source counts as changed. Sources that are known but not there are gone on a full run (sweep), and
    unchanged on a restricted one; those whose file is only missing for now (missing: source_id) are kept apart and never swept.
    """
    c = current.select("source_id", F.col("content_fp").alias("c1"), F.col("meta_fp").alias("m1"), (force if force is not None else F.lit(False)).alias("forced"))
    k = known.select("source_id", F.col("content_fp").alias("c0"), F.col("meta_fp").alias("m0"))
    both = c.join(k, "source_id", "full_outer")
    if missing is not None:
        both = both.join(missing.select("source_id", F.lit(True).alias("away")), "source_id", "left")
    else:
        both = both.withColumn("away", F.lit(None).cast("boolean"))
    out = (
        F.when(F.col("c1").isNull() & F.col("away"), MISSING)
        .when(F.col("c1").isNull(), GONE if sweep else SAME)
        .when(F.col("c0").isNull(), NEW)
        .when(F.col("forced") | (F.col("c1") != F.col("c0")), CHANGED)
        .when(F.col("m1") != F.col("m0"), META)
        .otherwise(SAME)
    )
    return both.select("source_id", out.alias("class"))


def replaced(stored: DataFrame, fresh: DataFrame, sources: DataFrame, key: str = "source_id") -> DataFrame:
    """stored without any row of the sources, plus the fresh rows: a source is replaced as a whole or not at all."""
    return stored.join(sources.select(key).distinct(), key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def upsert(stored: DataFrame, fresh: DataFrame, keys: Sequence[str]) -> DataFrame:
    return stored.join(fresh.select(*keys).distinct(), list(keys), "left_anti").unionByName(fresh)


def meta_updated(stored: DataFrame, fresh: DataFrame, keys: str | Sequence[str], columns: Sequence[str]) -> DataFrame:
    """stored with the columns of fresh where it has the keys; texts stay."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    f = fresh.select(*keys, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_{c}") for c in columns])
    out = stored.join(f, keys, "left")
    return out.select(*[F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in stored.columns])


def content_fingerprint(*parts: Column, version: int = CHUNKER_VERSION) -> Column:
    """A source's content fingerprint: the version of the chunker is part of it, so that a new version takes every source up again."""
    return fingerprint(F.lit(version), *parts)


class Snapshots:
    """Tables kept as immutable Parquet folders by buckets of their key, under one versioned pointer.

    A version says for each table which folder holds each bucket. Writing makes new folders for the touched buckets only, then
    the next version's file appears under its final name at once; the highest number counts. Readers see all tables of one version
    or of another, never a mixture, and a writer that dies leaves the last version as it was. Two writers can't both make the same
    version: the second one fails. All paths go through Hadoop's file system, so the store can be anywhere that Spark writes to.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 32, key: str = "source_id"):
        self.spark, self.root, self.buckets, self.key = spark, root.rstrip("/"), buckets, key
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        at = self._path(f"{self.root}/versions")
        return sorted(int(f.getPath().getName()[:-5]) for f in self._fs.listStatus(at) if f.getPath().getName().endswith(".json")) if self._fs.exists(at) else []

    def _describe(self, number: int) -> dict[str, dict]:
        return json.loads(self.spark.read.text(f"{self.root}/versions/{number:08d}.json", wholetext=True).first()[0])

    def version(self) -> tuple[int, dict[str, dict]]:
        """The last version's number and its tables; 0 and none before the first."""
        known = self._versions()
        return (known[-1], self._describe(known[-1])) if known else (0, {})

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _open(self, table: dict, only: Sequence[int] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(table["schema"])
        paths = [f"{self.root}/{folder}/_bucket={b}" for b, folder in table["folders"].items() if only is None or int(b) in only]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, name: str) -> DataFrame | None:
        table = self.version()[1].get(name)
        return None if table is None else self._open(table)

    def commit(self, changes: dict[str, tuple[DataFrame, DataFrame, Callable[[DataFrame], DataFrame] | None]]) -> int:
        """Make the next version. changes: table -> (rows to add, keys whose rows go first, what else becomes of rows that stay, if anything).

        Only buckets of those keys and rows are read and written; the driver sees their numbers.
        """
        number, tables = self.version()
        tables = {k: {**v, "folders": dict(v["folders"])} for k, v in tables.items()}
        for name, (fresh, gone, change) in changes.items():
            touched = sorted({r[0] for f in (fresh, gone) for r in f.select(self._bucket()).distinct().collect()})
            if name in tables:
                stay = self._open(tables[name], touched)
                stay = stay.join(gone.select(self.key).distinct(), self.key, "left_anti")
                rows = (change(stay) if change else stay).unionByName(fresh, allowMissingColumns=True)
            else:
                rows = fresh
            folder = f"{name}-{uuid.uuid4().hex}"
            rows.withColumn("_bucket", self._bucket()).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.root}/{folder}")
            written = {f.getPath().getName().partition("=")[2] for f in self._fs.listStatus(self._path(f"{self.root}/{folder}")) if f.isDirectory()}
            folders = {} if name not in tables else {b: f for b, f in tables[name]["folders"].items() if int(b) not in touched}
            tables[name] = {"schema": json.loads(rows.schema.json()), "folders": folders | {b: folder for b in written if b}}
        fresh_file = self._path(f"{self.root}/versions/.{uuid.uuid4().hex}")
        out = self._fs.create(fresh_file)
        out.write(bytearray(json.dumps(tables).encode()))
        out.close()
        target = self._path(f"{self.root}/versions/{number + 1:08d}.json")
        if self._fs.exists(target) or not self._fs.rename(fresh_file, target):
            raise OSError(f"version {number + 1} of {self.root} is there already: another writer was first")
        return number + 1

    def clean(self, keep: int = 2) -> None:
        """Delete all but the last `keep` versions and the folders that no kept one names. Not while another writer is at work."""
        known = self._versions()
        named = {f for n in known[-keep:] for t in self._describe(n).values() for f in t["folders"].values()}
        for n in known[:-keep]:
            self._fs.delete(self._path(f"{self.root}/versions/{n:08d}.json"), False)
        for f in self._fs.listStatus(self._path(self.root)):
            name = f.getPath().getName()
            if name != "versions" and name not in named:
                self._fs.delete(f.getPath(), True)


def sync(store: Snapshots, current: DataFrame, build: Callable[[DataFrame], DataFrame], sweep: bool = True, texts: Sequence[str] = ("chunk",), force: Column | None = None, missing: DataFrame | None = None) -> dict[str, int]:
    """Bring the stored chunks up to date with the current sources (source_id, content_fp, meta_fp, ...), in one version.

    build turns sources into chunks (source_id, seq, ..., error). New and changed sources are replaced as a whole; of those whose
    metadata alone changed all columns but texts are updated, by (source_id, seq). A source with any error is left as it was and not
    recorded, so the next run takes it up again. Tables: chunks, known. Returns the number of sources in each class.
    """
    before, stored = store.read("known"), store.read("chunks")
    if before is None:
        before = current.select("source_id", "content_fp", "meta_fp").limit(0)
    classes = diff(current, before, sweep, force, missing).persist()
    of = lambda *names: current.join(classes.where(F.col("class").isin(*names)), "source_id", "left_semi")
    built = build(of(NEW, CHANGED, META)).persist()
    failed = built.where("error is not null").select("source_id").distinct()
    rows = built.join(failed, "source_id", "left_anti").drop("error")
    whole, meta = (of(*names).join(failed, "source_id", "left_anti").select("source_id", "content_fp", "meta_fp") for names in ((NEW, CHANGED), (META,)))
    gone = classes.where(F.col("class") == GONE).select("source_id")
    fresh = rows.join(whole, "source_id", "left_semi")
    if stored is not None:
        # rows whose metadata changed go in again with their stored texts
        renewed = meta_updated(stored.join(meta, "source_id", "left_semi"), rows.join(meta, "source_id", "left_semi"), ["source_id", "seq"], [c for c in rows.columns if c in stored.columns and c not in ("source_id", "seq", *texts)])
        fresh = fresh.unionByName(renewed, allowMissingColumns=True)
    recorded = whole.unionByName(meta)
    touched = recorded.select("source_id").unionByName(gone)
    store.commit({"chunks": (fresh, touched, None), "known": (recorded, touched, None)})
    counts = {r["class"]: r["count"] for r in classes.groupBy("class").count().collect()}
    classes.unpersist(), built.unpersist()
    return counts
