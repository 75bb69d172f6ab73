"""Helpers that several training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these ASCII white-space characters; bytes.split() without arguments uses the same set.
WORD_SPACES = " \t\n\v\f\r"
#: Rows and bytes that an operator handles at once. Spark bounds the batches it sends by bytes (arrow.maxBytesPerBatch, 64 MB); these are slices of them.
BATCH_ROWS, BATCH_BYTES = 400, 8 << 20


def slices(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about `size` bytes and at most `rows` rows, without copying; no setting of the session is touched."""
    for b in batches:
        step = max(1, min(rows, b.num_rows * size // max(1, b.nbytes)))
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Unset on one machine (tests): one of our own; on a cluster: an error."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not set_dir:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        set_dir = tempfile.mkdtemp(prefix="lexiloom-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(set_dir)
    return set_dir.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors, is computed once.

    What drop_written() hasn't deleted before goes when the application ends: a lazy result may read it until then.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexiloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(*frames: DataFrame) -> None:
    """Delete what written() wrote for the frames, once nothing will read it any more."""
    for df in frames:
        jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            if path.getParent().getName() == "lexiloom":
                path.getFileSystem(conf).delete(path, True)


def kept_rows(docs: DataFrame, text_col: str, keep: Callable[[list[str | None]], list[bool]]) -> DataFrame:
    """The rows of docs, all columns, whose texts keep() says yes to: one pass without a shuffle or a join on ids.

    keep() gets null texts as None and decides on them; repeated rows are each decided alike; texts of any length come whole.
    """
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield b.filter(pa.array(keep(b.column(at).to_pylist()), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_sizes(rows: DataFrame) -> DataFrame:
    """rows (node, id, component, ...) of nodes that members of two components are in, with size, their members.

    Rows are dealt by node and a salt of the id, and only one count a salt meets by node: a very common token's or key's node, with a
    third of all rows, is spread over as many tasks as there are shuffle partitions.
    """
    salts = shuffle_partitions(rows.sparkSession)
    dealt = rows.withColumn("s", F.pmod(F.xxhash64("id"), F.lit(salts))).repartition("node", "s")
    parts = dealt.groupBy("node", "s").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    sizes = parts.groupBy("node").agg(F.sum("n").alias("size"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.collect_set("s").alias("s")).where("lo != hi")
    return dealt.join(sizes.select("node", "size", F.explode("s").alias("s")), ["node", "s"]).drop("s")


def _with_least(x: DataFrame, salts: int) -> DataFrame:
    """x (u, v) with m, the least v of each u, without bringing all of a hub's rows together: they meet by u and a salt of v."""
    x = x.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(salts))).repartition("u", "s")
    parts = x.groupBy("u", "s").agg(F.min("v").alias("m"))
    low = parts.groupBy("u").agg(F.min("m").alias("m"), F.collect_set("s").alias("s")).select("u", "m", F.explode("s").alias("s"))
    return x.join(low, ["u", "s"]).select("u", "v", "m")


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) links of comparable ids -> (node, component), component the smallest id reachable from node.

    Alternating large-star and small-star rounds. A node's links are dealt by node and a salt of the neighbour, and only one minimum
    a salt meets by node: a hub with a third of all links spreads over as many tasks as there are shuffle partitions. The rounds
    grow with the logarithm of the diameter; each is written to the shared folder, the one before deleted. They end once every
    link goes straight to a node that has none below it, so links that are such stars from the start take no round. Null ids
    and self-links are dropped. No links: no rows.
    """
    salts = shuffle_partitions(edges.sparkSession)
    e = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "edges")

    def settled(x: DataFrame) -> bool:
        """Whether each u has one v and no v is a u; counts are combined before the shuffle."""
        ends = x.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("below")), F.struct(F.col("v").alias("x"), F.lit(0).alias("below")))).alias("p"))
        by = ends.groupBy("p.x").agg(F.sum("p.below").alias("n"), F.min("p.below").alias("least"))
        return by.where("n > 1 or (n = 1 and least = 0)").limit(1).count() == 0

    while not settled(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: neighbours above u hang on u's least
        big = _with_least(both, salts).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        # small star: u and its neighbours below hang on u's least
        small = _with_least(big, salts).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("p"))
        old, e = e, written(small.select("p.u", "p.v").where("u > v").distinct(), "edges")
        drop_written(old)
    heads = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(heads)
