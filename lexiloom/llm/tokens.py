"""Operator 1: token counts by heap-and-linked-list byte-pair merging."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import slices

#: The byte-level vocabularies' rule for pieces within which merges happen (a fixed value).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct stretches whose counts a Python worker remembers, and the longest that it remembers.
REMEMBERED, REMEMBERED_CHARS = 500_000, 40
#: Bits of a symbol's number in a pair's key, and of a place in a heap entry.
SHIFT, PLACE = 20, 40


def _byte_names() -> dict[int, str]:
    """The printable characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the rest from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return {b: chr(b if b in own else next(rest)) for b in range(256)}


class MergeCounter:
    """Counts the tokens of byte-level BPE, without ever making an id.

    A piece starts as one symbol a byte, in a doubly linked list. A heap holds the adjacent pairs that have a rank; the lowest
    (leftmost among equals) is popped and merged, and the pairs on its two sides are pushed. An entry whose symbols have
    changed meanwhile is skipped. The count is the initial symbols minus the merges: O(n log n) also for pieces of any length.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = {c: b for b, c in _byte_names().items()}
        symbol = {bytes([b]): b for b in range(256)}  # a symbol's bytes -> its number, for short keys only
        raw = lambda s: symbol.setdefault(bytes(to_byte[c] for c in s), len(symbol))
        self.rank: dict[int, int] = {}  # two symbols -> rank
        self.made: list[int] = []  # rank -> the symbol that its merge makes
        for m in spec["model"]["merges"]:
            x, y = m.split(" ") if isinstance(m, str) else m
            self.rank[raw(x) << SHIFT | raw(y)] = len(self.made)
            self.made.append(raw(x + y))
        self.first = [self.rank.get(a << SHIFT | b, -1) for a in range(256) for b in range(256)]
        self.special = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.pieces = regex.compile(PIECES)
        self.cut = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.uneven = regex.compile(r" [\s\x1c-\x1f]|[\s\x1c-\x1f] ")
        self.known: dict[str, int] = {}  # filled until REMEMBERED, then kept as older while a new one fills
        self.older: dict[str, int] = {}

    def merges(self, piece: bytes) -> int:
        n, rank, made, push, pop = len(piece), self.rank, self.made, heapq.heappush, heapq.heappop
        part, get, first = list(piece), rank.get, self.first
        now = [first[a << 8 | b] for a, b in zip(piece, piece[1:])]
        now.append(-1)
        # r << PLACE | place: one integer orders by rank, then from the left
        heap = [r << PLACE | i for i, r in enumerate(now) if r >= 0]
        if not heap:
            return 0
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        done = 0
        while heap:
            e = pop(heap)
            r, i = e >> PLACE, e & (1 << PLACE) - 1
            if now[i] != r:  # its symbols have changed meanwhile
                continue
            j = after[i]
            part[i] = x = made[r]
            done += 1
            now[j] = now[i] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                r = get(x << SHIFT | part[k])
                if r is not None:
                    now[i] = r
                    push(heap, r << PLACE | i)
            h = before[i]
            if h >= 0:
                r = get(part[h] << SHIFT | x)
                if r is None:
                    now[h] = -1
                else:
                    now[h] = r
                    push(heap, r << PLACE | h)
        return done

    def stretch(self, text: str) -> int:
        """Tokens of a stretch that no piece crosses."""
        n = self.known.get(text)
        if n is None:
            n = self.older.get(text)
            if n is None:
                pieces = self.pieces.findall(text)
                if len(pieces) > 1:
                    n = sum(map(self.stretch, pieces))
                else:
                    b = text.encode("utf-8", "replace")
                    n = len(b) - self.merges(b)
            if len(text) <= REMEMBERED_CHARS:
                if len(self.known) >= REMEMBERED:
                    self.older, self.known = self.known, {}
                self.known[text] = n
        return n

    def plain(self, text: str) -> int:
        if not text:
            return 0
        if self.uneven.search(text):
            return sum(map(self.stretch, self.pieces.findall(text)))
        # Single spaces only: each space opens a new stretch, so words can be looked up instead of matched.
        head, *words = text.split(" ")
        stretch, n = self.stretch, self.stretch(head) if head else 0
        for w in words:
            n += stretch(" " + w)
        return n

    def count(self, text: str | None) -> int:
        """Tokens of a whole text. A special token's string counts one, as the library splits it off by default."""
        if not text:
            return 0
        if self.cut is None or not any(s in text for s in self.special):
            return self.plain(text)
        return sum(map(self.plain, self.cut.split(text))) + len(self.cut.findall(text))


_counters: dict[str, MergeCounter] = {}


def counter(path: str) -> MergeCounter:
    """One counter a Python worker and vocabulary."""
    if path not in _counters:
        _counters[path] = MergeCounter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, n_tokens, over_limit) of every row: one pass without a shuffle.

    vocabulary: path of a byte-level BPE .json, the same on all executors. A null or empty text has 0 bytes and 0 tokens; a null
    id stays null; repeated rows are each counted; other columns, whatever their names, are neither read nor returned. Memory: one
    Arrow batch of bounded rows and at most REMEMBERED short stretches a worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(vocabulary)
        for b in slices(batches):
            texts = b.column(1).to_pylist()
            n = [c.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(t.encode("utf-8", "replace")) if t else 0 for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=["id", "n_bytes", "n_tokens", "over_limit"],
            )

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
