"""Where results go: CSV with a byte-order mark, grouped Markdown, text with a report, the manifest of finished files."""

from __future__ import annotations

import csv
import io

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sync import upsert

BOM = "﻿"


def _file_system(spark: SparkSession, path: str) -> tuple:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One file, by Hadoop's file system: written beside its name first, so that nobody reads half of it."""
    fs, target = _file_system(spark, path)
    beside = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.part")
    out = fs.create(beside, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    fs.delete(target, False)
    if not fs.rename(beside, target):
        raise OSError(f"can't put {path} in its place")


def write_csv_folder(df: DataFrame, path: str) -> None:
    """A table of any size as CSV parts with headers, all values quoted where needed, nulls empty."""
    df.write.option("header", True).option("escape", '"').option("nullValue", "").mode("overwrite").csv(path)


def write_csv_file(df: DataFrame, path: str, most: int = 100_000) -> None:
    """A report of at most so many rows as one CSV file with a byte-order mark, as spreadsheets want it. More rows: an error, nothing is cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} rows: write_csv_folder takes any number")
    out = io.StringIO()
    writer = csv.writer(out)
    writer.writerow(df.columns)
    writer.writerows(["" if v is None else v for v in r] for r in rows)
    write_text(df.sparkSession, path, BOM + out.getvalue())


def annotation_markdown(rows: DataFrame) -> DataFrame:
    """(item_key, markdown): embedded annotations (item_key, author, year, title, attachment_key, page, page_label, kind, body, remark, place).

    place orders an item's rows; attachments come as they are first seen, with a heading if there are several; quotes stay on one line.
    """
    heading = F.concat_ws(" ", F.when(F.col("author") != "", F.col("author")), F.when(F.col("year") != "", F.concat(F.lit("("), "year", F.lit(")"))))
    title = F.concat(F.lit("*"), "title", F.lit("*"))
    heading = F.when(F.col("title") == "", heading).otherwise(F.when(heading == "", title).otherwise(F.concat(heading, F.lit(". "), title)))
    page = F.concat(F.lit("p. "), F.col("page").cast("string"), F.when((F.col("page_label") != "") & (F.col("page_label") != F.col("page").cast("string")), F.concat(F.lit(" ["), "page_label", F.lit("]"))).otherwise(""))
    quote = F.when(F.col("body") != "", F.concat(F.lit("\n  > "), F.translate("body", "\n", " ")))
    remark = F.when(F.col("remark") != "", F.concat(F.when(F.col("body") != "", "\n").otherwise(""), F.lit("\n  **Comment:** "), "remark"))
    entry = F.concat(F.lit("- **"), page, F.lit("** · "), "kind", F.coalesce(quote, F.lit("")), F.coalesce(remark, F.lit("")), F.lit("\n"))
    each = rows.select("item_key", "attachment_key", "place", entry.alias("entry"), heading.alias("heading"))
    parts = each.groupBy("item_key", "attachment_key").agg(F.min("place").alias("first"), F.min_by("heading", "place").alias("heading"), F.transform(F.array_sort(F.collect_list(F.struct("place", "entry"))), lambda x: x["entry"]).alias("entries"))
    items = parts.groupBy("item_key").agg(F.min_by("heading", "first").alias("heading"), F.array_sort(F.collect_list(F.struct("first", "attachment_key", "entries"))).alias("parts"))
    several = F.size("parts") > 1
    body = F.array_join(F.transform("parts", lambda p: F.concat(F.when(several, F.concat(F.lit("### Attachment "), p["attachment_key"], F.lit("\n\n"))).otherwise(""), F.array_join(p["entries"], "\n"))), "\n")
    named = F.when(F.col("heading") != "", F.col("heading")).otherwise(F.col("item_key").cast("string"))
    return items.select("item_key", F.concat(F.lit("## "), named, F.lit("\n\n"), body).alias("markdown"))


def append_new(stored: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """stored, untouched, then the fresh rows whose key it doesn't have: a plan only grows."""
    return stored.unionByName(fresh.dropDuplicates([key]).join(stored.select(key), key, "left_anti"))


def registered(manifest: DataFrame, row: DataFrame, attachments: DataFrame, items: DataFrame) -> DataFrame:
    """The manifest with one file that was made by hand: its attachment must be one, with an item above it."""
    found = row.join(attachments, "attachment_key", "left").first()
    if found is None or found["kind"] is None:
        raise ValueError("no such attachment")
    if found["kind"] != "attachment":
        raise ValueError(f"{found['attachment_key']} is a {found['kind']}, not an attachment")
    if found["item_key"] is None or items.where(F.col("item_key") == found["item_key"]).first() is None:
        raise ValueError(f"attachment {found['attachment_key']} has no item")
    return upsert(manifest, row.join(attachments.select("attachment_key", "item_key"), "attachment_key").select(*manifest.columns), ["attachment_key"])


def remove_partial(spark: SparkSession, folder: str, key: str, manifest: DataFrame, storage: str) -> list[str]:
    """Delete what a failed run left of a key (`key.*`), unless the manifest has it; never inside the storage folder. Returns the names."""
    if manifest.where(F.col("attachment_key") == key).first() is not None:
        return []
    fs, where = _file_system(spark, folder)
    full = fs.makeQualified(where).toString().rstrip("/")
    guarded = fs.makeQualified(_file_system(spark, storage)[1]).toString().rstrip("/")
    if f"{full}/".startswith(f"{guarded}/"):
        raise RuntimeError(f"refusing to delete inside {storage}")
    gone = [f.getPath() for f in fs.listStatus(where) if f.getPath().getName().startswith(f"{key}.")] if fs.exists(where) else []
    for p in gone:
        fs.delete(p, False)
    return sorted(p.getName() for p in gone)
