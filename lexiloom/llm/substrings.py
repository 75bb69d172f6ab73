"""Operator 3: removal of passages that repeat across documents, by super-k-mer partitioning of word windows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_written, shuffle_partitions, slices, written

#: Words of the m-mers whose hashes compete to be a window's minimiser.
MINIMISER_WORDS = 5
#: A map task sends what it has packed whenever it holds this many bytes of super-k-mers.
FLUSH_BYTES = 48 << 20
#: Buckets for each shuffle partition: a bucket is sorted in memory, so it should be a fraction of a partition.
BUCKETS_A_PARTITION = 8
#: Super-k-mers that a minimiser may have however few there are in all; beyond both this and a bucket's mean, its windows travel each by its own hash.
LIGHT = 100

_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
_M1, _M2, _BASE = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_ALL = (1 << 64) - 1


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _rolled(x: np.ndarray, n: int) -> np.ndarray:
    """A polynomial hash of every n consecutive values, by doubling: log2(n) passes."""
    out, have, power, x_power = None, 0, x, _BASE
    size = 1
    while True:
        if n & size:
            # the stretch so far, then the next `size` values
            out = power if out is None else out[: len(power) - have] * x_power + power[have : have + len(out)][: len(power) - have]
            have += size
            if have == n:
                return out[: len(x) - n + 1]
        power = power[: len(power) - size] * x_power + power[size:]
        x_power = np.uint64(int(x_power) ** 2 & _ALL)
        size *= 2


def _sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    size = 1
    while 2 * size <= n:
        x = np.minimum(x[: len(x) - size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (n - size)], x[n - size :]) if n > size else x


def _runs(words: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimisers, first words and numbers of words of the longest runs of windows that share a minimiser."""
    if len(words) < window:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    m = min(MINIMISER_WORDS, window)
    h = np.array(list(map(xxhash.xxh3_64_intdigest, words)), np.uint64)
    least = _sliding_min(_mixed(_rolled(h, m)), window - m + 1)
    starts = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    ends = np.append(starts[1:], len(least))
    return least[starts], starts, ends - starts + window - 1


def super_kmers(words: list[bytes], window: int) -> Iterator[tuple[int, int, int]]:
    """(minimiser, first word, number of words) of each longest run of windows that share a minimiser."""
    yield from zip(*(x.tolist() for x in _runs(words, window)))


def heavy_minimisers(docs: DataFrame, window: int, buckets: int) -> np.ndarray:
    """Minimisers with more super-k-mers than a bucket has on average (and than LIGHT), sorted: as many as there are buckets at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 4000):
            least, n = np.unique(np.concatenate([np.empty(0, np.uint64), *(_runs(text.as_py().split(), window)[0] for text in b.column(0))]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(least.view(np.int64)), pa.array(n)], names=["least", "n"])

    counts = written(docs.select("text").mapInArrow(count, "least long, n long").groupBy("least").agg(F.sum("n").alias("n")).where(F.col("n") > 1), "minimisers")
    total = counts.agg(F.sum("n")).first()[0] or 0
    out = [r["least"] for r in counts.where(F.col("n") > max(LIGHT, total / buckets)).select("least").collect()]
    drop_written(counts)
    return np.sort(np.array(out, np.int64).view(np.uint64))


def window_hashes(words: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each window, in two halves that come from different bits of its words' hashes."""
    h = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), "<u8").reshape(-1, 2)
    return tuple(_rolled(_mixed(np.ascontiguousarray(h[:, k]) + _BASE), window) for k in (0, 1))


def decided(high: np.ndarray, low: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which of these windows a smaller document among them has as well."""
    order = np.lexsort((doc, low, high))
    new = np.concatenate(([True], (high[order[1:]] != high[order[:-1]]) | (low[order[1:]] != low[order[:-1]])))[: len(order)]
    starts = np.flatnonzero(new)
    least = np.repeat(doc[order[starts]], np.diff(np.append(starts, len(order))))
    out = np.empty(len(order), bool)
    out[order] = least < doc[order]
    return out


def stretches(doc: np.ndarray, key: np.ndarray, start: np.ndarray, window: int) -> np.ndarray:
    """Windows as (document, text key, first word, end) rows of a matrix, neighbouring ones of a text in one."""
    order = np.lexsort((start, key, doc))
    doc, key, start = doc[order], key[order], start[order]
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]) | (start[1:] > start[:-1] + 1)))[: len(doc)]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc))[: len(first)] - 1
    return np.array([doc[first], key[first], start[first], start[last] + window], np.int64).reshape(4, len(first))


class _Ids(dict):
    """Words -> dense numbers, as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


_codec = None


def _zstd() -> pa.Codec:
    global _codec
    _codec = _codec or pa.Codec("zstd", compression_level=3)
    return _codec


def _packed(rows: list[tuple], done: np.ndarray, single: np.ndarray) -> bytes:
    """Super-k-mers (document, text key, first word, words, string), decided stretches (document, text key, first word, end) and single
    windows (document, text key, first word, two halves of a hash) in one compressed string."""
    head = np.array([len(rows), done.shape[1], single.shape[1]], "<i8").tobytes()
    body = b"".join(np.array([r[k] for r in rows], "<i8").tobytes() for k in range(4)) + done.astype("<i8").tobytes() + single.astype("<i8").tobytes()
    raw = head + body + b"\n".join(r[4] for r in rows)
    return np.array([len(raw)], "<i8").tobytes() + _zstd().compress(raw, asbytes=True)


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    raw = _zstd().decompress(blob[8:], int(np.frombuffer(blob, "<i8", 1)[0]), asbytes=True)
    n, d, w = np.frombuffer(raw, "<i8", 3).tolist()
    at = [24, 24 + 32 * n, 24 + 32 * (n + d), 24 + 32 * (n + d) + 40 * w]
    rows, done, single = (np.frombuffer(raw, "<i8", k * m, a).reshape(k, m) for k, m, a in ((4, n, at[0]), (4, d, at[1]), (5, w, at[2])))
    return rows, done, single, raw[at[3] :].split(b"\n") if n else []


class _Sender:
    """Collects a map task's super-k-mers by bucket.

    Of equal strings only those of the smallest document travel: all windows of the others start in a smaller document too, so
    they are decided here. A passage that a third of all rows hold therefore reaches its bucket once a flush, not once a row.
    Strings of a heavy minimiser are taken apart: of each of its windows only the smallest document's travels, to a bucket by the
    window's hash, so that neither a common phrase in ever other surroundings nor a common passage fills one bucket.
    """

    def __init__(self, window: int, buckets: int, heavy: np.ndarray):
        self.window, self.buckets, self.heavy = window, buckets, frozenset(heavy.tolist())
        self.clear()

    def clear(self) -> None:
        self.size = 0
        self.held: dict[bytes, tuple[int, list[tuple[int, int, int, int]]]] = {}
        self.done: list[tuple[int, int, int, int]] = []

    def add(self, doc: int, key: int, text: bytes) -> None:
        words = text.split()
        for least, start, n in super_kmers(words, self.window):
            s = b" ".join(words[start : start + n])
            have = self.held.get(s)
            if have is None or doc < have[1][0][0]:
                if have is None:
                    self.size += len(s) + 150
                else:
                    self.done += [(d, k, a, a + c) for d, k, a, c in have[1]]
                self.held[s] = (-1 if least in self.heavy else least % self.buckets, [(doc, key, start, n)])
            elif doc == have[1][0][0]:
                have[1].append((doc, key, start, n))
            else:
                self.done.append((doc, key, start, start + n))

    def flush(self) -> Iterator[tuple[int, bytes]]:
        rows: dict[int, list] = {}
        parts = []
        for s, (bucket, at) in self.held.items():
            if bucket >= 0:
                rows.setdefault(bucket, []).extend((*x, s) for x in at)
            else:
                high, low = window_hashes(s.split(b" "), self.window)
                parts += [(np.full(len(high), d), np.full(len(high), k), a + np.arange(len(high)), high, low) for d, k, a, _ in at]
        done = np.array(self.done, np.int64).reshape(-1, 4).T
        single = np.empty((5, 0), np.int64)
        if parts:
            doc, key, start, high, low = (np.concatenate([x[k] for x in parts]) for k in range(5))
            known = decided(high, low, doc)
            done = np.concatenate((done, stretches(doc[known], key[known], start[known], self.window)), axis=1)
            single = np.array([doc[~known], key[~known], start[~known], high[~known].view(np.int64), low[~known].view(np.int64)], np.int64)
        self.clear()
        of_done, of_single = (done[0] ^ done[1]) % self.buckets, single[4] % self.buckets
        done, single = done[:, np.argsort(of_done, kind="stable")], single[:, np.argsort(of_single, kind="stable")]
        edges = np.arange(self.buckets + 1)
        d, w = np.searchsorted(np.sort(of_done), edges).tolist(), np.searchsorted(np.sort(of_single), edges).tolist()
        for bucket in range(self.buckets):
            if bucket in rows or d[bucket] < d[bucket + 1] or w[bucket] < w[bucket + 1]:
                yield bucket, _packed(rows.get(bucket, []), done[:, d[bucket] : d[bucket + 1]], single[:, w[bucket] : w[bucket + 1]])


def repeated(docs: np.ndarray, strings: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    """(string, window within it) of each window whose words also make a window of a smaller document among these strings.

    Windows are sorted by a 64-bit hash of their words' numbers; equal neighbours are then compared word by word, and a run in
    which two differ is told apart by the words themselves. So windows that only collide are never taken for equal.
    """
    ids = _Ids()
    split = [s.split(b" ") for s in strings]
    sizes = np.array([len(s) for s in split], np.int64)
    w = np.concatenate([np.array(list(map(ids.__getitem__, s)), np.int64) for s in split])
    del split, ids
    counts = sizes - window + 1
    which = np.repeat(np.arange(len(sizes)), counts)
    inner = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = inner + np.repeat(np.cumsum(sizes) - sizes, counts)
    hashed = _rolled(_mixed(w.astype(np.uint64) + _BASE), window)[at]
    order = np.argsort(hashed, kind="stable")
    hashed = hashed[order]
    same = hashed[1:] == hashed[:-1]
    del hashed
    pairs = np.flatnonzero(same)
    a, b = at[order[pairs]], at[order[pairs + 1]]
    equal = np.ones(len(pairs), bool)
    for j in range(window):
        equal &= w[a + j] == w[b + j]
    group = np.concatenate(([0], np.cumsum(~same)))
    if not equal.all():
        bad = np.isin(group, group[pairs[~equal]])
        told: dict[tuple[int, bytes], int] = {}
        top = int(group[-1]) + 1
        group[bad] = [told.setdefault((int(g), w[at[i] : at[i] + window].tobytes()), top + len(told)) for g, i in zip(group[bad], order[bad])]
        again = np.argsort(group, kind="stable")
        group, order = group[again], order[again]
        same = group[1:] == group[:-1]
    starts = np.flatnonzero(np.concatenate(([True], ~same)))
    doc = docs[which[order]]
    least = np.repeat(np.minimum.reduceat(doc, starts), np.diff(np.append(starts, len(doc))))
    hit = np.sort(order[least < doc])
    return which[hit], inner[hit]


def repeated_stretches(docs: DataFrame, window: int = 50) -> DataFrame:
    """(doc_id, _key, from, to): words from..to-1 of a document (doc_id long, _key long, text binary) lie in a repeated window.

    A stretch may come in several overlapping parts. One shuffle, of packed strings: about three times the text before
    compression, whatever the window, since consecutive windows travel together. A first pass counts minimisers, so that the
    windows of those too heavy for a bucket are dealt by themselves (40 bytes each); these are compared by 128-bit hashes, all
    others word by word.
    """
    buckets = BUCKETS_A_PARTITION * shuffle_partitions(docs.sparkSession)
    heavy = docs.sparkSession.sparkContext.broadcast(heavy_minimisers(docs, window, buckets))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = _Sender(window, buckets, heavy.value)

        def out() -> Iterator[pa.RecordBatch]:
            for bucket, blob in sender.flush():
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([blob], pa.binary())], names=["bucket", "blob"])

        for b in slices(batches):
            for doc, key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                sender.add(doc, key, text.as_py())
                if sender.size >= FLUSH_BYTES:
                    yield from out()
        yield from out()

    def judge(table: pa.Table) -> pa.Table:
        parts, found, singles, strings = [], [], [], []
        for blob in table.column("blob"):
            r, d, w, s = _unpacked(blob.as_py())
            parts.append(r)
            found.append(d)
            singles.append(w)
            strings += s
        rows, single = np.concatenate(parts, axis=1), np.concatenate(singles, axis=1)
        if strings:
            which, inner = repeated(rows[0], strings, window)
            found.append(stretches(rows[0][which], rows[1][which], rows[2][which] + inner, window))
        known = decided(single[3], single[4], single[0])
        found.append(stretches(*single[:3, known], window))
        done = np.concatenate(found, axis=1)
        return pa.table({n: pa.array(done[k], pa.int64()) for k, n in enumerate(("doc_id", "_key", "from", "to"))})

    sent = docs.select("doc_id", "_key", "text").mapInArrow(send, "bucket int, blob binary")
    return sent.groupBy("bucket").applyInArrow(judge, "doc_id long, _key long, from long, to long")


def _without(text: bytes, stay: np.ndarray) -> bytes:
    """The text without the words that don't stay; each takes the white space after it along, all other white space stays."""
    out, at = [], 0
    spans = [m.span() for m in _WORDS.finditer(text)]
    gone = np.flatnonzero(~stay)
    first = gone[np.concatenate(([True], gone[1:] != gone[:-1] + 1))]
    last = gone[np.concatenate((gone[1:] != gone[:-1] + 1, [True]))]
    for a, z in zip(first.tolist(), last.tolist()):
        out.append(text[at : spans[a][0]])
        at = spans[z + 1][0] if z + 1 < len(spans) else len(text)
    return b"".join([*out, text[at:]])


def remove_repeated(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), respace: bool = True) -> DataFrame:
    """(id_col, n_words, n_removed, kept, and the columns named in carry): every row of docs without the words of windows that start in a smaller document too.

    Words are runs of bytes other than space and \\t\\n\\v\\f\\r; kept is the remaining words joined by one space, or with respace=False
    the text with its own white space, without the removed words and the white space after each. Windows are judged on the input, so
    the first document of a passage (the smallest id) keeps it. Texts that are null, empty or under `window` words lose nothing;
    null ids neither lose nor take anything; rows of one id never take words from each other, whether equal or not. Ids must be
    whole numbers. Columns not in carry are not read; those in carry come unchanged, so they must not be named like the others.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).cast("binary").alias("text"), F.struct(F.lit(0).alias("_"), *[docs[c] for c in carry]).alias("rest"))
    rows = rows.withColumn("_key", F.xxhash64("text"))
    found = repeated_stretches(rows.where("doc_id is not null").select("doc_id", "_key", "text"), window)
    found = found.groupBy("doc_id", "_key").agg(F.collect_list(F.struct("from", "to")).alias("cuts"))
    joined = rows.join(found, ["doc_id", "_key"], "left").select("doc_id", "text", F.col("cuts.from").alias("a"), F.col("cuts.to").alias("z"), "rest")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            n, removed, kept = [], [], []
            for text, a, z in zip(b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist()):
                text = text.as_py()
                words = text.split()
                stay = np.ones(len(words), bool)
                if a:
                    gone = np.zeros(len(words) + 1, np.int64)
                    np.add.at(gone, a, 1)
                    np.add.at(gone, z, -1)
                    stay = np.cumsum(gone)[:-1] == 0
                n.append(len(words))
                removed.append(len(words) - int(stay.sum()))
                if respace:
                    kept.append(b" ".join(words if not removed[-1] else [words[i] for i in np.flatnonzero(stay).tolist()]))
                else:
                    kept.append(_without(text, stay) if removed[-1] else text)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), b.column(4)], names=["doc_id", "n_words", "n_removed", "kept", "rest"])

    schema = T.StructType.fromDDL("doc_id long, n_words long, n_removed long, kept string").add("rest", joined.schema["rest"].dataType)
    return joined.mapInArrow(cut, schema).select(F.col("doc_id").alias(id_col), "n_words", "n_removed", "kept", *[F.col("rest")[c].alias(c) for c in carry])
