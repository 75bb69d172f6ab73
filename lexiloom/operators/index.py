"""The stored keyword index: postings dealt by term into buckets, of which a query reads only its terms' own."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import folded

K1, B = 1.2, 0.75
#: A term in more than half of the rows counts this little, never nothing or less.
LEAST_IDF = 1e-6


def term_list(text: str | Column) -> Column:
    """A text's terms in order: runs of letters and numbers, in lower case, Latin letters without marks."""
    return F.filter(F.split(folded(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def word_counts(rows: DataFrame, id_col: str, words_col: str, places: bool = False, buckets: int = 0) -> DataFrame:
    """(id_col, term, tf) of each row's list of words, and with places also (positions, length): sorted within the row, so nothing is shuffled.

    With places and buckets also (bucket), and 500 rows at a time are sorted by bucket and term: a sort of the whole only merges them.
    """
    kind = rows.schema[id_col].dataType.simpleString()

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                b = whole.slice(k, 500)
                lists = b.column(1)
                words = lists.flatten().dictionary_encode()
                sizes = np.where(lists.is_valid().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy()), 0)
                doc = np.repeat(np.arange(len(sizes)), sizes)
                place = np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                code = words.indices.to_numpy()
                if buckets:
                    bucket = np.array([bucket_of(w, buckets) for w in words.dictionary.to_pylist()], np.int32)
                    by_term = pc.sort_indices(words.dictionary).to_numpy()
                    by_term = by_term[np.argsort(bucket[by_term], kind="stable")]
                    rank = np.empty(len(by_term), np.int64)
                    rank[by_term] = np.arange(len(by_term))
                    order = np.argsort(rank[code], kind="stable")  # by document and place already
                else:
                    order = np.lexsort((place, code, doc))
                doc, code, place = doc[order], code[order], place[order]
                first = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (code[1:] != code[:-1])))[: len(doc)])
                ends = np.append(first, len(doc))
                out = [b.column(0).take(pa.array(doc[first])), words.dictionary.take(pa.array(code[first])), pa.array(np.diff(ends))]
                if places:
                    out += [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(place, pa.int32())), pa.array(sizes[doc[first]].astype(np.int64))]
                if buckets:
                    out.append(pa.array(bucket[code[first]]))
                yield pa.RecordBatch.from_arrays(out, names=["id", "term", "tf", "positions", "length", "bucket"][: len(out)])

    schema = f"id {kind}, term string, tf long" + (", positions array<int>, length long" if places else "") + (", bucket int" if buckets else "")
    return rows.select(F.col(id_col).alias("id"), F.col(words_col).alias("w")).mapInArrow(invert, schema).withColumnRenamed("id", id_col)


def postings(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = 0) -> DataFrame:
    """(id, term, tf, positions, length): positions count from 0, length is the row's number of terms. Null and empty texts give no rows."""
    return word_counts(rows.select(F.col(id_col).alias("id"), term_list(text_col).alias("w")), "id", "w", places=True, buckets=buckets)


def shared_root(spark: SparkSession, name: str) -> str:
    """A new folder below the one that driver and executors share: spark.checkpoint.dir; unset on one machine (tests): one of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="lexiloom-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@dataclass(frozen=True)
class KeywordIndex:
    """postings (bucket, term, id, tf, positions, length) as stored, and the two numbers that scores need of the whole."""

    postings: DataFrame
    buckets: int
    rows: int
    mean_length: float

    @classmethod
    def build(cls, rows: DataFrame, root: str, id_col: str = "doc_id", text_col: str = "text", buckets: int = 16) -> KeywordIndex:
        """Write the index of rows to root and open it.

        Nothing is shuffled: each task sorts its own rows' postings by bucket and term and writes one file a bucket, so that a file's
        row groups can be skipped and the postings of a term in every row are spread over as many files as there are tasks.
        """
        spark = rows.sparkSession
        postings(rows, id_col, text_col, buckets).sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{root}/postings")
        n = rows.agg(F.count(F.lit(1)).alias("rows"))
        words = spark.read.schema("tf long").parquet(f"{root}/postings").agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("words"))
        lengths = n.join(F.broadcast(words)).select("rows", (F.col("words") / F.nullif("rows", F.lit(0))).alias("mean_length"))
        lengths.withColumn("crc32_buckets", F.lit(buckets)).write.parquet(f"{root}/statistics")
        return cls.open(spark, root)

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> KeywordIndex:
        s = spark.read.parquet(f"{root}/statistics").first()
        return cls(spark.read.parquet(f"{root}/postings"), s["crc32_buckets"], s["rows"], s["mean_length"] or 0.0)

    def of(self, terms: Sequence[str]) -> DataFrame:
        """The postings of the terms, from their buckets only."""
        if not terms:
            return self.postings.limit(0)
        return self.postings.where(F.col("bucket").isin(*sorted({bucket_of(t, self.buckets) for t in terms})) & F.col("term").isin(*terms))

    def starting(self, prefix: str) -> DataFrame:
        return self.postings.where(F.col("term").startswith(prefix))

    def bm25(self, terms: Sequence[str], k: int = 50, candidates: DataFrame | None = None) -> DataFrame:
        """(id, score) of the k best rows for any of the terms; terms are folded first.

        Statistics are over all rows; candidates (id) only drops rows from the ranking. A term's frequency is the number of its postings, which are read anyway.
        """
        found = self.of(list(dict.fromkeys(terms)))
        df = found.groupBy("term").agg(F.count(F.lit(1)).cast("double").alias("df"))
        idf = F.log((F.lit(float(self.rows)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        df = df.select("term", F.when(idf <= 0, LEAST_IDF).otherwise(idf).alias("idf"))  # one row a term of the query
        if candidates is not None:
            found = found.join(candidates, "id", "left_semi")
        norm = F.lit(K1) * (1 - B + B * F.col("length") / F.lit(self.mean_length))
        one = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + norm)
        return found.join(F.broadcast(df), "term").groupBy("id").agg(F.sum(one).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def bucket_of(term: str, buckets: int) -> int:
    return zlib.crc32(term.encode("utf-8", "replace")) % buckets
