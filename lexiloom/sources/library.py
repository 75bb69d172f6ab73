"""Scans of a library's records: paged JSON, attachments' paths, CSV tables that may be missing."""

from __future__ import annotations

import importlib
import json
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


def resolved_path(mode: Column, path: Column, storage: Column, base: Column) -> tuple[Column, Column]:
    """(kind of place, path) of an attachment: stored copies under the storage folder, linked files as they are or under the base folder, links without a path."""
    under_base = (mode == 2) & path.startswith("attachments:")
    place = F.when(mode.isin(0, 1), "stored").when(under_base, "base folder").when(mode == 2, "absolute").when(mode == 3, "none").otherwise("embedded")
    where = F.when(mode.isin(0, 1), F.concat_ws("/", storage, path)).when(under_base, F.concat_ws("/", base, F.substring_index(path, ":", -1))).when(mode == 2, path)
    return place, where


def read_attachments(spark: SparkSession, path: str, schema: str, keys: Sequence[str] = (), limit: int = 0) -> DataFrame:
    """The audit's rows of PDFs that are there (exists = yes, a path), of these attachments or items only, at most so many: an operator's choice."""
    rows = read_csv(spark, path, schema).where("exists = 'yes' and lower(content_type) like '%pdf%' and coalesce(path, '') != ''")
    rows = rows.where(F.col("attachment_key").isin(*keys) | F.col("item_key").isin(*keys)) if keys else rows
    return rows.limit(limit) if limit else rows


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """A recognition table as operators.records.text_lines takes it: tab-separated with a header; quotes mean nothing."""
    schema = "level int, page int, block int, par int, line int, word int, left int, top int, width int, height int, conf double, text string"
    return spark.read.csv(path, sep="\t", header=True, schema=schema, quote="", enforceSchema=True)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header, its byte-order mark ignored; no rows if the file isn't there."""
    try:
        return spark.read.csv(path, header=True, schema=schema, encoding="UTF-8", multiLine=True, escape='"')
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


class _Page(InputPartition):
    def __init__(self, start: int):
        self.start = start


def listing_error(status: int, what: str) -> str | None:
    """What a service's answer to a listing means; None if it is one."""
    return None if status == 200 else f"{what} was not found" if status == 404 else f"the service answered {status} for {what}"


class _PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.size = options.get("path", ""), int(options.get("size", 100))
        module, _, name = options.get("fetch", "").partition(":")
        if not module or not name or self.size < 1:
            raise ValueError("fetch must name a function as module:function, size must be positive")
        self.module, self.name = module, name

    def fetch(self, start: int, limit: int) -> tuple[list[dict], int]:
        """A page's rows and the listing's total; any answer but a listing is an error."""
        status, rows, total = getattr(importlib.import_module(self.module), self.name)(self.path, start, limit)
        if problem := listing_error(status, self.path or "the listing"):
            raise RuntimeError(problem)
        return rows, total

    def partitions(self) -> list[InputPartition]:
        _, total = self.fetch(0, 1)  # also the check that the service is there
        return [_Page(start) for start in range(0, total, self.size)] or [_Page(0)]

    def read(self, page: InputPartition):
        rows, _ = self.fetch(page.start, self.size)
        for k, r in enumerate(rows):
            yield (page.start + k, page.start // self.size, str(r["key"]), json.dumps(r, ensure_ascii=False))


class PagedItems(DataSource):
    """A paged listing: one partition a page, so pages are fetched side by side.

    Options: fetch, a function that executors can import, as module:function; path and size. The function gets (path, start, limit) and
    returns (status, rows, total): rows are dictionaries with a key, total is how many the listing has.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_items"

    def schema(self) -> str:
        return "position long, page long, item_key string, record string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _PagedReader(self.options)


def numbered_items(path: str, start: int, limit: int) -> tuple[int, list[dict], int]:
    """An offline listing of as many numbered items as path says."""
    total = int(path)
    return 200, [{"key": f"item{i}", "data": {"title": f"Title {i}"}} for i in range(start, min(start + limit, total))], total
