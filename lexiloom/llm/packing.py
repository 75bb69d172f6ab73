"""Operator 5: best-fit packing of token pieces into sequences, with large items matched in pairs first."""

from __future__ import annotations

import bisect
import json
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import shuffle_partitions, slices, written
from .tokens import PIECES, _byte_names

PIECE_SCHEMA = "piece int, start long, length long, ids_crc32 long"

#: Characters of one kind in a row from which a text goes to the tokenizers library: the faster one runs out of stack on about a million spaces.
LONG_RUN = 10_000
_long_run = regex.compile(r"\s{%d}|\p{L}{%d}|\p{N}{%d}|[^\s\p{L}\p{N}]{%d}" % (LONG_RUN, LONG_RUN, LONG_RUN, LONG_RUN))

_encodings: dict[str, tiktoken.Encoding] = {}
_libraries: dict[str, Tokenizer] = {}


def encoding(path: str) -> tiktoken.Encoding:
    """The vocabulary of a byte-level BPE .json whose ids follow its merges, so that ids can serve as ranks; checked on load.

    It gives the same ids as the tokenizers library (tests hold them against each other), several times as fast.
    """
    if path not in _encodings:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = {c: b for b, c in _byte_names().items()}
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        vocab = {bytes(to_byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        made = [vocab[bytes(to_byte[c] for c in "".join(m.split(" ") if isinstance(m, str) else m))] for m in spec["model"]["merges"]]
        if any(a >= b for a, b in zip(made, made[1:])):
            raise ValueError(f"the ids of {path} don't follow its merges")
        _encodings[path] = tiktoken.Encoding("packing", pat_str=PIECES, mergeable_ranks=vocab, special_tokens=special)
    return _encodings[path]


def token_ids(text: str | None, path: str) -> np.ndarray:
    """The ids of a whole text of any length, as the tokenizers library gives them; null: none."""
    if not text:
        return np.empty(0, np.uint32)
    if len(text) >= LONG_RUN and _long_run.search(text):
        if path not in _libraries:
            _libraries[path] = Tokenizer.from_file(path)
        return np.array(_libraries[path].encode(text, add_special_tokens=False).ids, np.uint32)
    return encoding(path).encode_to_numpy(text, allowed_special="all")


def cut(n: int, capacity: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of n ids: whole ones of the capacity, the shorter rest in front, which leaves one piece to fit."""
    start, length = 0, n % capacity or capacity
    while start < n:
        yield start, length
        start, length = start + length, capacity


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, piece, start, length, ids_crc32): the pieces of every row's ids and end_id. Null texts count as empty; texts of any length are read whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            at, rows = [], []
            for k, text in enumerate(b.column(1).to_pylist()):
                ids = np.append(token_ids(text, vocabulary), np.uint32(end_id)).astype("<u4")
                for p, (start, length) in enumerate(cut(len(ids), capacity)):
                    at.append(k)
                    rows.append((p, start, length, zlib.crc32(ids[start : start + length])))
            piece, start, length, crc = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["id", "piece", "start", "length", "ids_crc32"],
            )

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, {PIECE_SCHEMA}").withColumnRenamed("id", id_col)


def pack_counts(counts: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """How often to use which filling: [([(length, times), ...], bins)], from how often each length occurs.

    1. Large items, over a third of the capacity: at most two go into one bin. From the largest on, each takes the largest
       partner that still fits.
    2. Smaller items, from the largest on: into the tightest gap that takes them; a gap that takes one of a length takes as many
       more of it as it can, being the tightest still. New bins only when no gap fits.
    Bins that are filled alike are handled together, so the work depends on the capacity, not on the number of items.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    if any(not 0 < n <= capacity for n in left):
        raise ValueError("lengths must be from 1 to the capacity")
    large = sorted(n for n in left if 3 * n > capacity)
    gaps: dict[int, list[tuple[list[tuple[int, int]], int]]] = {}
    order: list[int] = []  # gaps in ascending order

    def put(fill: list[tuple[int, int]], bins: int, gap: int) -> None:
        if bins:
            if gap not in gaps:
                bisect.insort(order, gap)
                gaps[gap] = []
            gaps[gap].append((fill, bins))

    for x in reversed(large):
        while left[x]:
            k = bisect.bisect_right(large, min(capacity - x, x)) - 1
            while k >= 0 and left[large[k]] < (2 if large[k] == x else 1):
                k -= 1
            if k < 0:
                put([(x, 1)], left[x], capacity - x)
                left[x] = 0
            elif large[k] == x:
                pairs = left[x] // 2
                put([(x, 2)], pairs, capacity - 2 * x)
                left[x] -= 2 * pairs
            else:
                y = large[k]
                pairs = min(left[x], left[y])
                put([(x, 1), (y, 1)], pairs, capacity - x - y)
                left[x], left[y] = left[x] - pairs, left[y] - pairs
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        rest = left[n]
        while rest:
            k = bisect.bisect_left(order, n)
            if k == len(order):
                whole = -(-rest // (capacity // n))
                put([], whole, capacity)
                continue
            gap = order[k]
            fill, bins = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], order[k]
            times = gap // n
            full = min(bins, rest // times)
            put([*fill, (n, times)], full, gap - times * n)
            rest -= full * times
            if full < bins and rest:
                put([*fill, (n, rest)], 1, gap - rest * n)
                put(fill, bins - full - 1, gap)
                rest = 0
            elif full < bins:
                put(fill, bins - full, gap)
    return [(fill, bins) for gap in order for fill, bins in gaps[gap] if fill]


def pack(pieces: DataFrame, capacity: int = 1024, order_cols: tuple[str, ...] = ("doc_id", "piece", "ids_crc32")) -> DataFrame:
    """pieces (with a length long from 1 to capacity) plus sequence_id long and offset long: gapless sequences.

    Only the histogram of lengths reaches the driver: capacity rows at most. Its fillings come back as a broadcast table of slots
    whose size also depends on the capacity alone. A piece finds its slot by its rank among pieces of its length; ranks are
    counted in salted groups (length, hash) with offsets summed over the salts, so that a length held by a third of all
    pieces isn't ranked in one task. Pieces with equal order_cols and lengths are interchangeable. Empty input: no rows.
    """
    spark = pieces.sparkSession
    plan = pack_counts({r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}, capacity)
    slots, used, first = [], {}, 0
    for fill, bins in plan:
        offset = 0
        for length, times in fill:
            lo = used.get(length, 0)
            used[length] = lo + bins * times
            slots.append((length, lo, used[length], first, times, offset))
            offset += length * times
        first += bins
    table = spark.createDataFrame(slots, "length long, lo long, hi long, first_bin long, times long, base long")
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*order_cols), F.lit(shuffle_partitions(spark))))
    each = Window.partitionBy("length", "_salt")
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n")).select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = salted.withColumn("_rank", F.row_number().over(each.orderBy(*order_cols))).join(offsets, ["length", "_salt"])
    ranked = ranked.withColumn("_rank", F.col("_rank") - 1 + F.col("_before"))
    put = ranked.join(F.broadcast(table), "length").where("_rank >= lo and _rank < hi")
    q = F.col("_rank") - F.col("lo")
    return put.select(
        *[put[c] for c in pieces.columns],
        (F.col("first_bin") + F.expr("(_rank - lo) div times")).alias("sequence_id"),
        (F.col("base") + q % F.col("times") * F.col("length")).alias("offset"),
    )


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for documents (doc_id, text): tokens, pieces, packing.

    Only documents of over capacity ids are cut. A null or empty text has the end id alone; null ids and repeated rows are packed
    like any other; other columns are not read. The pieces (a few numbers each, no texts) are written to the shared folder once.
    """
    if sys.byteorder != "little":
        raise RuntimeError("ids_crc32 needs a little-endian machine")
    return pack(written(token_pieces(docs, vocabulary, capacity, end_id), "pieces"), capacity)
