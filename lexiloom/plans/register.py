"""The decorator that registers a query, and the library's tables as they are derived from the test tables, in Spark and SQL alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function of (spark, sf_dir) under its own name, with SQL that gives the same rows, where SQL can."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# The library's tables. Documents stand for chunks, conversations for annotations, orders for attachments, customers for items.

SOURCE_TYPES = ("pdf_text", "snapshot", "text_file", "highlight", "note", "embedded", "child_note", "metadata")
MINE = ("highlight", "note", "embedded", "child_note")

CHUNKS = f"""select doc_id, concat('c', cast(doc_id as varchar)) chunk_id, source item_key, concat(source, '-', cast(doc_id % 3 as varchar)) attachment_key,
 case cast(doc_id % 8 as int) {' '.join(f"when {i} then '{t}'" for i, t in enumerate(SOURCE_TYPES))} end source_type,
 cast(doc_id % 40 as int) pdf_page, lang, case when doc_id % 7 = 0 then '' when doc_id % 7 = 1 then 'undated' else cast(1400 + doc_id % 600 as varchar) end yr, text from documents"""
ANNOTATIONS = """select conv_id, turn, concat('a', cast(conv_id as varchar), '-', cast(turn as varchar)) ann_key, concat('att', cast(conv_id % 50 as varchar)) attachment_key, cast(turn as int) page,
 case when role = 'user' then 'highlight' when role = 'assistant' then 'note' else 'ink' end kind, case when conv_id % 3 = 0 then '' else text end body, case when turn % 2 = 0 then '' else concat('see ', cast(conv_id as varchar)) end remark,
 case when conv_id % 4 = 0 then '' else concat('Tag', cast(conv_id % 4 as varchar), '; method') end tags from conversations"""
ITEMS = """select c_custkey item_id, c_name title, c_mktsegment kind, concat('Author', cast(c_custkey % 97 as varchar)) surname, case when c_custkey % 9 = 0 then '' else cast(1900 + c_custkey % 120 as varchar) end yr, c_nationkey collection_key from customer"""
ATTACHMENTS = """select o_orderkey att_id, o_custkey item_id, case o_orderstatus when 'O' then 'application/pdf' when 'F' then 'text/html' else 'text/plain' end mime, cast(o_orderkey % 5 as int) mode, o_totalprice size from orders"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    kind = F.element_at(F.array(*[F.lit(t) for t in SOURCE_TYPES]), (F.col("doc_id") % 8 + 1).cast("int"))
    year = F.when(F.col("doc_id") % 7 == 0, "").when(F.col("doc_id") % 7 == 1, "undated").otherwise((1400 + F.col("doc_id") % 600).cast("string"))
    return d.select("doc_id", F.concat(F.lit("c"), "doc_id").alias("chunk_id"), F.col("source").alias("item_key"), F.concat_ws("-", "source", (F.col("doc_id") % 3).cast("string")).alias("attachment_key"), kind.alias("source_type"), (F.col("doc_id") % 40).cast("int").alias("pdf_page"), "lang", year.alias("yr"), "text")


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(
        "conv_id", "turn", F.concat(F.lit("a"), "conv_id", F.lit("-"), "turn").alias("ann_key"), F.concat(F.lit("att"), (F.col("conv_id") % 50).cast("string")).alias("attachment_key"), F.col("turn").cast("int").alias("page"),
        F.when(F.col("role") == "user", "highlight").when(F.col("role") == "assistant", "note").otherwise("ink").alias("kind"),
        F.when(F.col("conv_id") % 3 == 0, "").otherwise(F.col("text")).alias("body"), F.when(F.col("turn") % 2 == 0, "").otherwise(F.concat(F.lit("see "), "conv_id")).alias("remark"),
        F.when(F.col("conv_id") % 4 == 0, "").otherwise(F.concat(F.lit("Tag"), (F.col("conv_id") % 4).cast("string"), F.lit("; method"))).alias("tags"),
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("item_id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("kind"), F.concat(F.lit("Author"), (F.col("c_custkey") % 97).cast("string")).alias("surname"), F.when(F.col("c_custkey") % 9 == 0, "").otherwise((1900 + F.col("c_custkey") % 120).cast("string")).alias("yr"), F.col("c_nationkey").alias("collection_key"))


def attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    mime = F.when(F.col("o_orderstatus") == "O", "application/pdf").when(F.col("o_orderstatus") == "F", "text/html").otherwise("text/plain")
    return o.select(F.col("o_orderkey").alias("att_id"), F.col("o_custkey").alias("item_id"), mime.alias("mime"), (F.col("o_orderkey") % 5).cast("int").alias("mode"), F.col("o_totalprice").alias("size"))
