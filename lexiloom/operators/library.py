"""Operators over a library's items, attachments, annotations and chunks: filters, lookups, rollups."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.python_text import fold_accents


def metadata_filter(chunks: DataFrame, types: Sequence[str] = (), languages: Sequence[str] = (), items: Sequence[str] = (), tags: Sequence[str] = (), year_from: int = 0, year_to: int = 0, known_types: Sequence[str] = ()) -> DataFrame:
    """Rows that meet all given conditions; an empty condition is none. A year that isn't a number never meets a bound; a bound of 0 is none."""
    if wrong := sorted(set(types) - set(known_types)) if known_types else []:
        raise ValueError(f"unknown source types: {', '.join(wrong)}; known: {', '.join(known_types)}")
    if types:
        chunks = chunks.where(F.col("source_type").isin(*types))
    if languages:
        chunks = chunks.where(F.col("lang").isin(*languages))
    if items:
        chunks = chunks.where(F.col("item_key").isin(*items))
    if tags:
        chunks = chunks.where(F.arrays_overlap("tags", F.array(*[F.lit(t.lower()) for t in tags])))
    if year_from or year_to:
        year = F.when(F.col("yr").rlike("^[0-9]+$"), F.col("yr").cast("int"))
        chunks = chunks.where(year.isNotNull())
        chunks = chunks.where(year >= year_from) if year_from else chunks
        chunks = chunks.where(year <= year_to) if year_to else chunks
    return chunks


def matches_all_words(hay: Column, query: str) -> Column:
    """Every word of the query is a word of hay, or, from four letters on, part of it; case and accents don't matter."""
    plain = fold_accents(hay)
    words = re.findall(r"\w+", "".join(c for c in unicodedata.normalize("NFKD", query) if not unicodedata.combining(c)).lower())
    if not words:
        raise ValueError("give an author, a title word, a year or a publication to look for")
    have = F.split(plain, r"[^\p{L}\p{N}_]+")
    each = [F.array_contains(have, w) | (plain.contains(w) if len(w) >= 4 else F.lit(False)) for w in words]
    return reduce(lambda a, b: a & b, each)


def first_of_each(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row for each key, the first in order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_first", F.row_number().over(w)).where("_first = 1").drop("_first")


def capped(rows: DataFrame, order: Sequence[Column], group: Sequence[str], text: str, cap: int) -> DataFrame:
    """Rows of each group in order, as long as their JSON stays within cap characters; a first row that is too long alone is cut, not dropped."""
    size = F.length(F.to_json(F.struct(*[F.col(c) for c in rows.columns])))
    w = Window.partitionBy(*group).orderBy(*order)
    sized = rows.withColumn("_size", size).withColumn("_sum", F.sum("_size").over(w)).withColumn("_no", F.row_number().over(w))
    kept = sized.where((F.col("_sum") <= cap) | (F.col("_no") == 1))
    room = F.greatest(F.lit(500), F.length(text) - (F.col("_size") - cap))
    cut = F.when(F.col("_size") > cap, F.concat(F.substring(F.col(text), F.lit(1), room), F.lit(" […]"))).otherwise(F.col(text))
    return kept.withColumn(text, cut).drop("_size", "_sum", "_no")


def collection_paths(spark: SparkSession, nodes: DataFrame, root: str) -> DataFrame:
    """(key, path, depth) of a forest (key, name, parent) below root: names joined by ` / `, the root's own not among them."""
    return spark.sql(
        """WITH RECURSIVE tree(key, path, depth) AS (
             SELECT key, concat('(', name, ' root)'), 0 FROM {nodes} WHERE key = :root
             UNION ALL
             SELECT c.key, CASE WHEN t.depth = 0 THEN c.name ELSE concat(t.path, ' / ', c.name) END, t.depth + 1 FROM {nodes} c JOIN tree t ON c.parent = t.key)
           SELECT key, path, depth FROM tree""",
        args={"root": root},
        nodes=nodes,
    )
