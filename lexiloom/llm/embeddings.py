"""Operator 2: near-duplicate vectors by an inverted multi-index: codebooks on vector halves, multi-sequence traversal, verification."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import connected_components, drop_written, slices, written

#: Vectors that the codebooks are fitted on, at most; distinct vectors a cell should hold on average; most centroids of a half.
SAMPLE, CELL, MOST_CENTROIDS = 20_000, 100, 1024
#: Share of the pairs at exactly the threshold, the hardest ones, of which at least one traversal has to reach the other's cell.
RECALL = 0.998
#: Components and rows of a block on either side: a row of the grid is compared block by block, so that no task gathers a hot cell;
#: within a block, tiles of so many rows are multiplied at once.
BLOCK_SIZE, BLOCK_ROWS, TILE = 1 << 22, 8192, 1024
#: Steps of a unit in which vectors are placed. Distances are then sums of whole numbers under 2**53: exact, in whatever order they are added.
GRID = float(1 << 15)


def _placing(x: np.ndarray) -> np.ndarray:
    return np.rint(x * GRID)


def _distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * (x @ centroids.T) + (centroids * centroids).sum(1), 0)


def _k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = np.concatenate([_distances(x[i : i + 2048], c).argmin(1) for i in range(0, len(x), 2048)])
        sums, n = np.zeros_like(c), np.bincount(near, minlength=k)
        np.add.at(sums, near, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


@dataclass
class MultiIndex:
    """Codebooks of the two halves, and how far beyond the nearest cell a traversal goes (in squared distance), all on the placing grid."""

    left: np.ndarray
    right: np.ndarray
    reach: float

    @property
    def half(self) -> int:
        return self.left.shape[1]

    def both(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of placed vectors to the left and to the right centroids: exact whole numbers."""
        return _distances(x[:, : self.half], self.left), _distances(x[:, self.half :], self.right)

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self.both(x)
        return a.argmin(1) * len(self.right) + b.argmin(1)

    def visits(self, x: np.ndarray) -> Iterator[list[int]]:
        """Each row's cells in ascending distance, while within reach: the multi-sequence traversal of the product grid."""
        a, b = self.both(x)
        oa, ob = a.argsort(1, kind="stable"), b.argsort(1, kind="stable")
        sa, sb = np.take_along_axis(a, oa, 1), np.take_along_axis(b, ob, 1)
        n = len(self.right)
        for da, db, ia, ib in zip(sa.tolist(), sb.tolist(), oa.tolist(), ob.tolist()):
            most = da[0] + db[0] + self.reach
            heap, out = [(da[0] + db[0], 0, 0)], []
            while heap:
                d, i, j = heapq.heappop(heap)
                out.append(ia[i] * n + ib[j])
                # each cell is pushed once: along its row, and down only from the first column; none beyond reach
                if j + 1 < len(db) and da[i] + db[j + 1] <= most:
                    heapq.heappush(heap, (da[i] + db[j + 1], i, j + 1))
                if j == 0 and i + 1 < len(da) and da[i + 1] + db[0] <= most:
                    heapq.heappush(heap, (da[i + 1] + db[0], i + 1, 0))
            yield out

    def meets(self, x: np.ndarray, homes: np.ndarray) -> np.ndarray:
        """Whether each placed vector's traversal visits each of the cells: what visits() would say, exactly."""
        a, b = self.both(x)
        far = a[:, homes // len(self.right)] + b[:, homes % len(self.right)]
        return far <= (a.min(1) + b.min(1) + self.reach)[:, None]


def fit_index(sample: np.ndarray, total: int, cosine: float, recall: float = RECALL, seed: int = 11) -> MultiIndex:
    """Codebooks that grow with the square root of the number of vectors, and the reach that the target recall needs.

    A pair is found if either of its traversals reaches the other's cell. The reach is measured on partners made at exactly the
    threshold's angle in random directions from sampled vectors: real links are at least as close, so their recall is at least
    that (tests measure it against brute force).
    """
    rng = np.random.default_rng(seed)
    half = sample.shape[1] // 2
    k = int(np.clip(round((total / CELL) ** 0.5), 1, min(MOST_CENTROIDS, len(sample))))
    index = MultiIndex(_placing(_k_means(sample[:, :half], k, rng)), _placing(_k_means(sample[:, half:], k, rng)), 0.0)
    if k == 1:
        return index
    x = sample[rng.integers(0, len(sample), 4000)]
    side = rng.normal(size=x.shape)
    side -= (side * x).sum(1)[:, None] * x
    length = np.linalg.norm(side, axis=1)[:, None]
    y = cosine * x + np.sqrt(max(0.0, 1 - cosine**2)) * side / np.where(length > 0, length, 1)
    x, y = _placing(x), _placing(y)
    i = np.arange(len(x))

    def beyond(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        (a, b), at = index.both(p), index.cells(q)
        return a[i, at // k] - a.min(1) + b[i, at % k] - b.min(1)

    index.reach = float(np.ceil(np.quantile(np.minimum(beyond(x, y), beyond(y, x)), recall)))
    return index


def _unit(rows: pa.Array, dtype: str) -> np.ndarray:
    x = np.frombuffer(b"".join(rows.to_pylist()), dtype).reshape(len(rows), -1).astype(np.float64)
    x = x / np.abs(x).max(1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def _raw_vectors(lists: pa.ListArray, dtype: str) -> list[bytes | None]:
    """Each vector's bytes; None where it is null, empty, zero or holds a null or a non-finite component."""
    at = lists.offsets.to_numpy()
    x = lists.values.slice(int(at[0]), int(at[-1] - at[0])).to_numpy(zero_copy_only=False)  # of this slice only; nulls come as NaN
    at = at - at[0]
    x = (x + 0.0).astype(dtype)  # -0 is 0
    bad, some = (np.concatenate(([0], np.cumsum(c))) for c in (~np.isfinite(x), x != 0))
    fine = (bad[at[1:]] == bad[at[:-1]]) & (some[at[1:]] > some[at[:-1]]) & lists.is_valid().to_numpy(zero_copy_only=False)
    raw, size = x.tobytes(), np.dtype(dtype).itemsize
    return [raw[a * size : z * size] if ok else None for a, z, ok in zip(at[:-1].tolist(), at[1:].tolist(), fine.tolist())]


def _spread(linked: np.ndarray, q: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest id reachable within a block's links, for its query and base rows: few rows say what all links would."""
    big = np.iinfo(np.int64).max
    while True:
        old = q.sum(dtype=np.float64), b.sum(dtype=np.float64)
        q = np.minimum(q, np.where(linked, b[None, :], big).min(1, initial=big))
        b = np.minimum(b, np.where(linked, q[:, None], big).min(0, initial=big))
        if old == (q.sum(dtype=np.float64), b.sum(dtype=np.float64)):
            return q, b


def link_vectors(vectors: DataFrame, cosine: float = 0.9, recall: float = RECALL, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id_col, n_links, component_id, kept) of every row of vectors.

    Equal vectors are one class, compared once and counted as often as it has rows; vectors of each length have an index of their
    own. Each class visits the cells within reach, a line of the grid at a time; what it meets there is verified in double
    precision, block by block, so a hot cell takes many small tasks; of a tile only counts and one link to the smallest reachable id a row leave it. A link counts at
    both its ends, once each: a block counts its query rows, and those base rows whose own traversal doesn't come to the query
    row's cell (where it does, another block counts them). Links with nothing, so n_links 0 and itself as component: vectors
    that are null, empty, zero or hold a null or a non-finite component. Null ids get component null, are kept, and are linked
    with nothing. Rows that repeat an id count as other vectors to each other but share its component. Other columns are not
    read; ids must be whole numbers. An empty table gives no rows.

    To the driver: a row for each vector length, and for each length with over CELL vectors a sample of at most SAMPLE of them.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[vec_col].dataType.elementType
    dtype = "<f4" if isinstance(kind, T.FloatType) else "<f8"
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), (vectors[vec_col] if dtype == "<f4" else vectors[vec_col].cast("array<double>")).alias("v"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2000):
            out = _raw_vectors(b.column(1), dtype)
            k = np.frombuffer(b"".join(xxhash.xxh3_128_digest(raw or b"") for raw in out), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(k[:, 0]), pa.array(k[:, 1]), pa.array([len(raw or b"") for raw in out], pa.int32()), pa.array(out, pa.binary())], names=["id", "k1", "k2", "size", "raw"])

    read_rows = written(rows.mapInArrow(read, "id long, k1 long, k2 long, size int, raw binary"), "vectors")
    result = lambda n, c: [F.col("id").alias(id_col), n.cast("long").alias("n_links"), c.alias("component_id"), F.coalesce(F.col("id") == c, F.lit(True)).alias("kept")]
    fit = read_rows.where("size > 0 and id is not null")
    # equal bytes have equal lengths, so a class has one
    classes = written(fit.groupBy("k1", "k2").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("rows"), F.min_by("raw", "id").alias("raw")).withColumn("no", F.xxhash64("k1", "k2")), "classes")
    lengths = {r["size"]: r["n"] for r in classes.groupBy(F.length("raw").alias("size")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not lengths:
        return read_rows.select(*result(F.lit(0), F.col("id")))
    indexes: dict[int, MultiIndex] = {}
    for size, total in sorted(lengths.items()):
        if total > CELL:
            sample = classes.where(F.length("raw") == size).orderBy("no").limit(SAMPLE).select("raw").collect()
            indexes[size] = fit_index(_unit(pa.array([bytes(r["raw"]) for r in sample], pa.binary()), dtype), total, cosine, recall)
        else:
            d = size // np.dtype(dtype).itemsize
            indexes[size] = MultiIndex(np.zeros((1, d // 2)), np.zeros((1, d - d // 2)), 0.0)
    sent = spark.sparkContext.broadcast(indexes)
    names = ["size", "line", "asks", "home", "id", "no", "rows", "raw", "rights"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A base row in each vector's own line of the grid (a left centroid's cells), a query row in each line that it visits.

        home is the vector's own cell, rights are the right centroids of the visited cells in the line: neighbouring cells
        share a vector's trip, so trips grow with the visited lines only.
        """
        for whole in slices(batches, 2000):
            sizes = np.array([len(r) for r in whole.column(3).to_pylist()])
            for size in np.unique(sizes).tolist():
                b = whole.take(pa.array(np.flatnonzero(sizes == size)))
                index, x = sent.value[size], _placing(_unit(b.column(3), dtype))
                home, width = index.cells(x), len(index.right)
                for asks, seen in ((False, home[:, None].tolist()), (True, list(index.visits(x)))):
                    at = np.repeat(np.arange(len(x)), [len(s) for s in seen])
                    cell = np.fromiter((c for s in seen for c in s), np.int64, len(at))
                    order = np.lexsort((cell, at))
                    at, line, right = at[order], cell[order] // width, cell[order] % width
                    first = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (line[1:] != line[:-1]))))
                    rights = pa.ListArray.from_arrays(pa.array(np.append(first, len(at)), pa.int32()), pa.array(right, pa.int32()))
                    at = at[first]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), size, np.int32)), pa.array(line[first]), pa.array(np.full(len(at), asks)), pa.array(home[at]), *(b.column(k).take(pa.array(at)) for k in range(4)), rights], names=names)

    placed = classes.select("id", "no", "rows", "raw").mapInArrow(place, "size int, line long, asks boolean, home long, id long, no long, rows long, raw binary, rights array<int>")
    # vectors aren't needed to count the lines' rows
    sizes = placed.groupBy("size", "line").agg(F.count_if("asks").alias("q"), F.count_if(~F.col("asks")).alias("b")).where("q > 0 and b > 0")
    block = F.greatest(F.lit(256), F.least(F.lit(BLOCK_ROWS), F.expr(f"{BLOCK_SIZE * np.dtype(dtype).itemsize} div size")))
    sizes = sizes.select("size", "line", F.ceil(F.col("q") / block).alias("qs"), F.ceil(F.col("b") / block).alias("bs"))
    own = F.when(F.col("asks"), F.pmod("no", "qs")).otherwise(F.pmod("no", "bs"))
    others = F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("asks"), F.col("bs")).otherwise(F.col("qs")) - 1))
    dealt = placed.join(sizes, ["size", "line"]).withColumn("own", own).withColumn("other", others)
    dealt = dealt.select(*names, F.when(F.col("asks"), F.col("own")).otherwise(F.col("other")).alias("qb"), F.when(F.col("asks"), F.col("other")).otherwise(F.col("own")).alias("bb"))

    def verify(block: pa.Table) -> pa.Table:
        asks = block.column("asks").to_numpy()
        home, id_, no, weight = (block.column(c).to_numpy() for c in ("home", "id", "no", "rows"))
        x = _unit(block.column("raw").combine_chunks(), dtype)
        index = sent.value[int(block.column("size")[0].as_py())]
        lists = block.column("rights").combine_chunks()
        row, right = np.repeat(np.arange(len(x)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()
        order = np.argsort(right, kind="stable")
        row, right = row[order], right[order]
        edges = np.flatnonzero(np.concatenate(([True], right[1:] != right[:-1], [True])))
        counts = np.zeros(len(x), np.int64)
        links = []

        def tile(q: np.ndarray, b: np.ndarray) -> None:
            linked = x[q] @ x[b].T >= cosine
            linked &= (no[q][:, None] != no[b][None, :]) | (id_[q][:, None] != id_[b][None, :])
            some, met = np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0))
            if not len(some):
                return
            linked, q, b = linked[np.ix_(some, met)], q[some], b[met]
            counts[q] += (linked @ weight[b].astype(np.float64)).astype(np.int64)
            homes, which = np.unique(home[q], return_inverse=True)
            comes = index.meets(_placing(x[b]), homes)
            counts[b] += (weight[q].astype(np.float64) @ (linked & ~comes[:, which].T)).astype(np.int64)
            lq, lb = _spread(linked, id_[q], id_[b])
            links.append((np.concatenate((id_[q], id_[b])), np.concatenate((lq, lb))))

        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
            here = row[lo:hi]
            q, b = here[asks[here]], here[~asks[here]]
            for i in range(0, len(q) if len(b) else 0, TILE):
                for j in range(0, len(b), TILE):
                    tile(q[i : i + TILE], b[j : j + TILE])
        node, least = (np.concatenate([p[k] for p in links]) if links else np.empty(0, np.int64) for k in (0, 1))
        node, least = np.unique(np.stack((node, least))[:, node != least], axis=1)
        some = counts > 0
        n = int(some.sum())
        zeros = np.zeros(max(n, len(node)), np.int64)
        return pa.table({
            "no": pa.array(np.concatenate((no[some], zeros[: len(node)]))), "n": pa.array(np.concatenate((counts[some], zeros[: len(node)]))),
            "a": pa.array(np.concatenate((id_[some], node))), "b": pa.array(np.concatenate((zeros[:n], least))), "link": pa.array(np.arange(n + len(node)) >= n),
        })

    met = written(dealt.groupBy("size", "line", "qb", "bb").applyInArrow(verify, "no long, n long, a long, b long, link boolean"), "met")
    found = met.where(~F.col("link")).groupBy("no", F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    links = connected_components(met.where("link").select("a", "b").distinct()).withColumnRenamed("node", "id")
    about = classes.join(found, ["no", "id"], "left").join(links, "id", "left").select("k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("rows") - 1).alias("n"), F.coalesce("component", "id").alias("c"))
    about = written(about, "about")
    drop_written(classes, met)
    out = read_rows.select("id", "k1", "k2", "size").join(about, ["k1", "k2"], "left")
    known = F.col("id").isNotNull() & (F.col("size") > 0)
    component = F.when(F.col("id").isNotNull(), F.coalesce("c", "id"))
    return out.select(*result(F.when(known, F.coalesce("n", F.lit(0))).otherwise(0), component))
