"""Operator 10: near-duplicate documents by a chosen-path set similarity join over minwise tokens."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, drop_written, shuffle_partitions, slices, with_sizes, written
from .substrings import _mixed, _rolled

#: Minwise tokens of a document: the coordinates among which paths choose, and the sketch that nodes compare.
TOKENS = 128
#: Independent trees. A pair of similarity s that meets in a leaf of depth d is missed by all with (1 - s**d) ** TREES: under
#: 3e-10 at depth 1 and 2e-6 at depth 2 for 0.75. Below that every second node branches by two tokens: members have 3/2 children
#: on average and a pair of 0.75 keeps 9/8 in common, so that it stays together in a tree with 4/9 of those it starts in at
#: any depth, and is missed by all trees with (2/3) ** TREES, 0.0015, however large its group. Two tokens as long as unused ones are left.
TREES, DOUBLE_LEVELS = 16, TOKENS // 2 - 1
#: Members of a large node that each of its members is tried against before it branches.
PIVOTS = 4
#: Documents of a node up to which it is compared exhaustively; larger nodes branch on. From a depth of DEEP tokens in common on,
#: branching hardly splits any more, and a node may be larger.
NODE, DEEP, DEEP_NODE = 1024, 3, 4096
#: Shingles that a worker holds at once when members of a node are compared exactly, a longer single text aside.
HELD = 2_000_000
#: Bits an id, and bits at least and at most (32 MB), of the map of ids that leaves others' texts out; bits of a chunk of it.
ID_BITS, LEAST_BITS, MOST_BITS, CHUNK_BITS = 32, 1 << 16, 1 << 28, 1 << 15
#: Share of equal tokens from which a pair is confirmed on full sets: 0.75 less four deviations.
CANDIDATE = 0.6

_rng = np.random.default_rng(20)
_XOR = _rng.integers(0, 1 << 32, TOKENS, np.uint32)
_TIMES = _rng.integers(0, 1 << 31, TOKENS, np.uint32) * np.uint32(2) + np.uint32(1)
#: The coordinates of each tree's levels: a different first one for each tree, then the others in random order.
PATHS = np.array([[t * (TOKENS // TREES), *_rng.permutation([c for c in range(TOKENS) if c != t * (TOKENS // TREES)])] for t in range(TREES)])


def shingle_set(text: bytes | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles: A-Z lower-cased, ASCII white space between words; a text of fewer words is one shingle."""
    w = (text or b"").lower().split()
    if not w:
        return np.empty(0, np.uint64)
    h = np.array(list(map(xxhash.xxh3_64_intdigest, w)), np.uint64)
    n = min(words, len(w))
    return np.unique(_mixed(_rolled(h, n) + np.uint64(n)))


def minwise(hashes: np.ndarray) -> np.ndarray:
    """TOKENS minwise tokens of a set, a linear permutation of 32 bits each."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(TOKENS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 1024):
        np.minimum(least, ((x[None, i : i + 1024] ^ _XOR[:, None]) * _TIMES[:, None]).min(1), out=least)
    return least


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, on full sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n, k1, k2, tokens): set size, 128 bits that stand for the set, minwise tokens (null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            n, k1, k2, tokens = [], [], [], []
            for text in b.column(1):
                s = shingle_set(text.as_py(), words)
                key = xxhash.xxh3_128_intdigest(s.tobytes())
                n.append(len(s))
                k1.append(_signed(key >> 64))
                k2.append(_signed(key & (1 << 64) - 1))
                tokens.append(minwise(s).astype("<u4").tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(tokens, pa.binary())], names=["doc_id", "n", "k1", "k2", "tokens"])

    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(run, "doc_id long, n long, k1 long, k2 long, tokens binary")


def _matrix(column: pa.Array) -> np.ndarray:
    """Binary rows of TOKENS little-endian 32-bit tokens, as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(len(column), TOKENS)


def _branch(path: np.ndarray, token: np.ndarray) -> np.ndarray:
    """The child's name: the node's name mixed with the chosen token."""
    return _mixed(_mixed(path.astype(np.uint64)) + token.astype(np.uint64)).view(np.int64)


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tree, node, id) of each set in each tree's first level."""
    for b in batches:
        tokens = _matrix(b.column(1))
        for t in range(TREES):
            node = _branch(np.full(len(tokens), t, np.uint64), tokens[:, PATHS[t, 0]])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(tokens), t, np.int32)), pa.array(node), b.column(0)], names=["tree", "node", "id"])


def forest(ids: np.ndarray, sketch: np.ndarray) -> list[tuple[int, int]]:
    """Each member of a node with the most alike one, as a maximum spanning forest of its candidate pairs: one pair a member at most."""
    n = len(ids)
    best, by, free = np.full(n, -1), np.zeros(n, int), np.ones(n, bool)
    out, i = [], 0
    for _ in range(n):
        free[i] = False
        alike = (sketch == sketch[i]).sum(1)
        better = free & (alike > best)
        best[better], by[better] = alike[better], i
        i = int(np.where(free, best, -2).argmax())
        if free[i] and best[i] >= CANDIDATE * TOKENS:
            out.append((by[i], i))
    return _named(ids, out)


def across(ids: np.ndarray, sketch: np.ndarray, component: np.ndarray) -> np.ndarray:
    """Which members of a node have a candidate in another component."""
    out = np.zeros(len(ids), bool)
    if (component == component[0]).all():
        return out
    for i in range(len(ids) - 1):
        other = i + 1 + np.flatnonzero(component[i + 1 :] != component[i])
        if len(other):
            hit = other[(sketch[other] == sketch[i]).sum(1) >= CANDIDATE * TOKENS]
            out[hit] = True
            out[i] |= bool(len(hit))
    return out


def links_across(ids: list[int], component: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Exact links between components of a node: one of each member with each other component that it is linked to.

    Intersections are counted along the shingles' postings, so every pair with a shingle in common is looked at, exactly.
    """
    of, sizes = np.array(component), np.array([len(s) for s in sets])
    if (of == of[0]).all():
        return []
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, term = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(term, kind="stable")
    posted = owner[order]
    starts = np.concatenate(([0], np.cumsum(np.bincount(term))))
    at = np.concatenate(([0], np.cumsum(sizes)))
    out = []
    for i in range(len(sets) - 1):
        mine = term[at[i] : at[i + 1]]
        lo, n = starts[mine], starts[mine + 1] - starts[mine]
        where = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        both = np.bincount(posted[where], minlength=len(sets))
        hit = (100 * both >= percent * (sizes + sizes[i] - both)) & (of != of[i])
        hit[: i + 1] = False
        j = np.flatnonzero(hit)
        out += [(i, int(k)) for k in j[np.unique(of[j], return_index=True)[1]]]
    return _named(np.array(ids), out)


def _named(ids: np.ndarray, pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    named = ((int(ids[i]), int(ids[j])) for i, j in pairs)
    return [(min(p), max(p)) for p in named if p[0] != p[1]]


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """node, id, component and sketch of whole nodes, many at a time, from rows sorted by node; a node may go on in the next batch."""
    held = [np.empty(0, np.int64)] * 3 + [np.empty((0, TOKENS), np.uint8)]
    for b in batches:
        new = [b.column(k).to_numpy() for k in range(3)] + [np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint8).reshape(-1, TOKENS)]
        held = [np.concatenate(x) for x in zip(held, new)]
        last = np.searchsorted(held[0], held[0][-1]) if len(held[0]) else 0
        if last:
            yield tuple(x[:last] for x in held)
            held = [x[last:] for x in held]
    if len(held[0]):
        yield tuple(held)


def _bounds(node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
    return starts, np.diff(np.append(starts, len(node)))


def _likeliest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b): each node's forest."""
    for node, ids, component, sketch in _nodes(batches):
        starts, sizes = _bounds(node)
        two = starts[sizes == 2]
        two = two[((sketch[two] == sketch[two + 1]).sum(1) >= CANDIDATE * TOKENS) & (ids[two] != ids[two + 1])]
        pairs = list(zip(np.minimum(ids[two], ids[two + 1]).tolist(), np.maximum(ids[two], ids[two + 1]).tolist()))
        for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            pairs += forest(ids[s : s + n], sketch[s : s + n])
        pairs = list(dict.fromkeys(pairs))
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"])


def _undecided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, id, component) of members with a candidate in another component."""
    for node, ids, component, sketch in _nodes(batches):
        keep = np.zeros(len(node), bool)
        for s, n in zip(*(x.tolist() for x in _bounds(node))):
            keep[s : s + n] = across(ids[s : s + n], sketch[s : s + n], component[s : s + n])
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (node, ids, component)], names=["node", "id", "component"])


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [r.tobytes() for r in (_matrix(b.column(1)) & np.uint32(0xFF)).astype(np.uint8)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.binary())], names=["id", "sketch"])


def _coordinate(tree: np.ndarray, level: int) -> np.ndarray:
    """The token that a node of this level branches by: the path's, and once two-token levels are over, all of the path again."""
    return PATHS[tree, level if level <= DOUBLE_LEVELS else level - DOUBLE_LEVELS]


def small_nodes(sets: DataFrame, decide: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame | None]:
    """(node, id) of all nodes small enough to compare, and (id, component) of members of larger ones that links join, if any do.

    sets: (id long, tokens binary), written, one row a distinct set. decide: the links among pairs (a, b), on full sets. Level by
    level: nodes with one member end, small ones are done; each member of a larger one is first tried against the likeliest of the
    node's PIVOTS, from CANDIDATE on and on full sets, and then branches by the next token of its tree (every second node: by two).
    A branch whose members are all in one component ends: no pair of it can change any. Once a path has been through all tokens,
    members agree on every token with the pivots they were tried against, so no node is cut off. decide gets pairs (a, b, part): b is a pivot. Only counts of rows left reach the driver.
    """
    nodes = sets.select("id", "tokens").mapInArrow(_roots, "tree int, node long, id long")
    live = written(with_sizes(nodes.withColumn("component", F.col("id"))), "nodes")
    sketches = sets.select("id", "tokens").mapInArrow(_sketches, "id long, sketch binary")
    small, found = [live.where(F.col("size") <= NODE).select("node", "id")], None
    hot = live.where(F.col("size") > NODE)
    level = 0
    while level < DOUBLE_LEVELS + TOKENS - 1 and hot.limit(1).count():
        level += 1
        # the same order in every node, so that a group's pivots are the same ones in most trees
        drawn = hot.groupBy("node").agg(F.first("size").alias("size"), *[F.min_by(F.struct("id", "component"), F.xxhash64("id", F.lit(k))).alias(f"p{k}") for k in range(PIVOTS)])
        drawn = drawn.select("node", "size", F.posexplode(F.array(*[f"p{k}" for k in range(PIVOTS)])).alias("k", "p")).select("node", "size", "k", F.col("p.id").alias("id"), F.col("p.component").alias("pc"))
        drawn = drawn.join(sketches, "id").groupBy("node", "size").agg(F.sort_array(F.collect_list(F.struct("k", "id", "pc", "sketch"))).alias("p"))
        # a node's pivots go to each of its parts of about NODE members
        shares = lambda size: F.ceil(size / NODE)
        pivots = drawn.select("node", F.explode(F.sequence(F.lit(0).cast("long"), shares(F.col("size")) - 1)).alias("part"), F.col("p.id").alias("pid"), F.col("p.pc").alias("pc"), F.concat(*[F.col("p")[k]["sketch"] for k in range(PIVOTS)]).alias("psketch"))

        def chosen(batches: Iterator[pa.RecordBatch], level: int = level) -> Iterator[pa.RecordBatch]:
            # of a member's tokens, only its sketch and the two that it may branch by go on to where its pivots are
            for b in batches:
                tokens, tree, at = _matrix(b.column(5)), b.column(0).to_numpy(), np.arange(b.num_rows)
                sketch = pa.array([r.tobytes() for r in (tokens & np.uint32(0xFF)).astype(np.uint8)], pa.binary())
                by = [tokens[at, _coordinate(tree, level)], tokens[at, PATHS[tree, TOKENS - min(level, TOKENS)]]]
                yield pa.RecordBatch.from_arrays([*b.columns[:5], sketch, *(pa.array(x.astype(np.int64)) for x in by)], names=["tree", "node", "id", "component", "part", "sketch", "first", "second"])

        def step(batches: Iterator[pa.RecordBatch], level: int = level) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                node, ids = b.column(1).to_numpy().view(np.uint64), b.column(2).to_numpy()
                mine = np.frombuffer(b"".join(b.column(4).to_pylist()), np.uint8).reshape(-1, TOKENS)
                first, second = (b.column(k).to_numpy() for k in (5, 6))
                pid, pc = (b.column(k).flatten().to_numpy().reshape(-1, PIVOTS) for k in (7, 8))
                sketch = np.frombuffer(b"".join(b.column(9).to_pylist()), np.uint8).reshape(-1, PIVOTS, TOKENS)
                alike = (sketch == mine[:, None, :]).sum(2)
                alike[pc == b.column(3).to_numpy()[:, None]] = -1  # links within a component change nothing
                at, best = np.arange(len(ids)), alike.argmax(1)
                to = pa.array(pid[at, best], mask=alike[at, best] < CANDIDATE * TOKENS)
                child = _branch(node, first)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(child), b.column(2), to, b.column(10)], names=["tree", "node", "id", "to", "part"])
                two = np.flatnonzero(_mixed(node) % np.uint64(2) == 0) if level <= DOUBLE_LEVELS else []
                if len(two):
                    child = _branch(~node[two], second[two])
                    at = pa.array(two)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array(child), b.column(2).take(at), pa.nulls(len(two), pa.int64()), b.column(10).take(at)], names=["tree", "node", "id", "to", "part"])

        parted = hot.withColumn("part", F.pmod(F.xxhash64("id"), shares(F.col("size"))))
        own = parted.join(sets.select("id", "tokens"), "id").select("tree", "node", "id", "component", "part", "tokens").mapInArrow(chosen, "tree int, node long, id long, component long, part long, sketch binary, first long, second long")
        full = own.join(pivots, ["node", "part"]).select("tree", "node", "id", "component", "sketch", "first", "second", "pid", "pc", "psketch", "part")
        told = written(full.mapInArrow(step, "tree int, node long, id long, to long, part long"), "branches")
        tried = written(told.where("to is not null").groupBy(F.col("id").alias("a"), F.col("to").alias("b")).agg(F.min("part").alias("part")), "tried")
        if tried.limit(1).count():
            links = decide(tried)
            before = found
            if before is not None:
                links = links.unionByName(before.where("id != component").select(F.col("id").alias("a"), F.col("component").alias("b")))
            found = written(connected_components(links).withColumnRenamed("node", "id"), "components")
            if before is not None:
                drop_written(before)
        named = told.select("tree", "node", "id")
        named = named.withColumn("component", F.col("id")) if found is None else named.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
        live = written(with_sizes(named), "nodes")
        drop_written(told, tried)
        most = NODE if level + 1 < DEEP else DEEP_NODE
        small.append(live.where(F.col("size") <= most).select("node", "id"))
        hot = live.where(F.col("size") > most)
    return reduce(DataFrame.unionByName, small), found


def texts_of(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The texts (id, text binary) that some pair names, and a few others, written without a shuffle: a map of the ids' hashes goes to all tasks.

    No named text is lost. Of the others, one in 16 at most is left up to 8,000,000 pairs, and more beyond: joins on ids have to follow.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (ID_BITS * pairs.count()).bit_length()))
    bit = F.pmod(F.xxhash64("id"), F.lit(bits))
    chunk, place = F.floor(bit / CHUNK_BITS), F.pmod(bit, F.lit(CHUNK_BITS))
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    maps = ids.select(chunk.alias("_chunk"), place.alias("_place")).repartition("_chunk").groupBy("_chunk").agg(F.bitmap_construct_agg("_place").alias("_map"))
    byte = F.conv(F.hex(F.substring("_map", F.floor(F.col("_place") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    looked = texts.withColumn("_chunk", chunk).withColumn("_place", place).join(F.broadcast(maps), "_chunk")
    return written(looked.where(F.getbit(byte, F.pmod("_place", F.lit(8)).cast("int")) == 1).select(*texts.columns), "texts")


def confirmed(pairs: DataFrame, held: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough; held: (id, text binary).

    pairs may have a part: b, a pivot of very many, then has its text sent once a part, and no task gets all of its pairs.
    """
    first, second = (held.select(F.col("id").alias(x), F.col("text").alias(f"t{x}")).hint("merge") for x in "ab")
    on = ["b"]
    if "part" in pairs.columns:
        on = ["b", "part"]
        second = second.join(pairs.select(*on).distinct().hint("merge"), "b").hint("merge")
    both = pairs.join(first, "a").join(second, on)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple[bytes, np.ndarray]] = {}

        def of(i: int, text: bytes) -> np.ndarray:
            if i not in known or known[i][0] != text:
                if len(known) >= 64:
                    known.clear()
                known[i] = (text, shingle_set(text, words))
            return known[i][1]

        for b in slices(batches):
            a, z = b.column(0).to_pylist(), b.column(1).to_pylist()
            ok = [similar(of(x, t.as_py()), of(y, u.as_py()), percent) for x, y, t, u in zip(a, z, b.column(2), b.column(3))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_shingles, component_id, kept) of every row of docs.

    Documents with equal sets are one class, represented by its smallest id; classes are joined by chosen paths, links confirmed
    on full sets, components made from the links. Copies are never expanded into pairs. A null or empty text has an empty set
    and links with nothing; a null id gets component null and is kept; rows that repeat an id are each judged by their own
    text; texts of any length are read whole; other columns are not read. Ids must be whole numbers.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    signed = written(signatures(rows, words), "signatures")
    filled = signed.where("doc_id is not null and n > 0")
    sets = written(filled.groupBy("k1", "k2").agg(F.min("doc_id").alias("id"), F.min_by("tokens", "doc_id").alias("tokens"), F.first("n").alias("n")), "sets")
    tokenless = written(signed.drop("tokens"), "signatures")
    drop_written(signed)
    texts = rows.where("doc_id is not null").select(F.col("doc_id").alias("id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))

    def decide(pairs: DataFrame) -> DataFrame:
        held = texts_of(pairs, texts)
        links = written(confirmed(pairs, held, words, percent), "links")
        drop_written(held)
        return links

    nodes, joined = small_nodes(sets, decide)
    sketches = sets.select("id", "tokens").mapInArrow(_sketches, "id long, sketch binary")
    parts = shuffle_partitions(docs.sparkSession)

    def by_node(members: DataFrame, what: DataFrame, of: str) -> DataFrame:
        return members.join(what, "id").select("node", "id", "component", of).repartition(parts, "node").sortWithinPartitions("node")

    # 1. the likeliest link of each member of each node: most components come out of these, however many links they have
    likely = by_node(nodes.withColumn("component", F.col("id")), sketches, "sketch").mapInArrow(_likeliest, "a long, b long")
    pairs = written(likely.distinct(), "pairs")
    held = texts_of(pairs, texts)
    links = written(confirmed(pairs, held, words, percent), "links")
    known = links if joined is None else links.unionByName(joined.where("id != component").select(F.col("id").alias("a"), F.col("component").alias("b")))
    found = written(connected_components(known), "components")
    # 2. members that still have candidates across two components: exact, node by node; pairs within one component can't change any
    members = nodes.join(found.withColumnRenamed("node", "id"), "id", "left").select("node", "id", F.coalesce("component", "id").alias("component"))
    mixed = members.groupBy("node").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("node")
    open_ = written(by_node(members.join(mixed, "node"), sketches, "sketch").mapInArrow(_undecided, "node long, id long, component long"), "undecided")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def judged(node: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
            out = links_across([x[0] for x in node], [x[1] for x in node], [x[2] for x in node], percent) if len(node) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], names=["a", "b"])

        now, node = None, []
        for b in slices(batches):
            for n, i, c, text, x, y in zip(*(b.column(k).to_pylist() for k in range(6))):
                if (n, x, y) != now:
                    yield judged(node)
                    now, node = (n, x, y), []
                node.append((i, c, shingle_set(text, words)))
        yield judged(node)

    # a node whose sets are too many for a worker is dealt in blocks, and every two blocks meet in a group of their own
    sized = open_.join(sets.groupBy("id").agg(F.max("n").alias("n")), "id")
    blocks = sized.groupBy("node").agg(F.ceil(2 * F.sum("n") / HELD).alias("blocks"))
    block = F.pmod(F.xxhash64("id"), F.col("blocks"))
    sized = sized.join(blocks, "node").withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("blocks") - 1, F.lit(0)))))
    sized = sized.select("node", "id", "component", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))
    further = sized.join(held, "id").select("node", "id", "component", "text", "x", "y").repartition(parts, "node", "x", "y").sortWithinPartitions("node", "x", "y").mapInArrow(exact, "a long, b long")
    further = written(further, "links")
    ends = found
    if further.limit(1).count():
        ends = connected_components(found.where("node != component").select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(further))
    drop_written(nodes, pairs, held, links, open_, further, *([] if joined is None else [joined]))
    classes = sets.select("k1", "k2", "id").join(ends.withColumnRenamed("node", "id"), "id", "left").select("k1", "k2", F.coalesce("component", "id").alias("c"))
    out = tokenless.join(classes, ["k1", "k2"], "left")
    component = F.when(F.col("n") > 0, F.coalesce("c", "doc_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, of one document a component: its smallest id. Repeated rows of that id and text are one; null ids stay."""
    kept = near_duplicates(docs, words, percent, id_col, text_col).where(F.col("kept") & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_kept")).distinct()
    named = docs.join(kept, docs[id_col] == kept["_kept"], "left_semi")
    named = named.withColumn("_text", F.xxhash64(text_col)).dropDuplicates([id_col, "_text"]).drop("_text")
    return named.unionByName(docs.where(docs[id_col].isNull()))
