"""Operator 6: SentencePiece encoding and decoding by a max-plus parallel scan."""

from __future__ import annotations

import pickle
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shuffle_partitions, slices, written

SPACE = "▁"
#: Characters of a chunk of a giant document; stretches that a worker remembers, and the longest of them.
CHUNK, REMEMBERED, REMEMBERED_CHARS = 65_536, 200_000, 40
#: A boundary's state: (start of the token across it, relative to it; its end; the token). The text's edge has this one.
State = tuple[int, int, str]
EDGE: State = (0, 0, "")
_NONE: dict[str, bool] = {}


class PieceScan:
    """The model's segmentation as the one path of finite weight in a graph of tokens.

    A sequence of tokens is what merging gives exactly if each two neighbours, put together and merged alone, give themselves
    again. So an edge between two tokens weighs 0 if they stand that test and minus infinity if not, and in the max-plus
    semiring a chunk of text is a matrix from the token across its left end to the token across its right end. Chunks'
    matrices are made independently, multiplied associatively, and each chunk's path is then traced on its own.
    """

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.text_of = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        plain = [i for i in range(len(self.text_of)) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.score = {self.text_of[i]: sp.get_score(i) for i in plain}
        self.id_of = {self.text_of[i]: i for i in plain}
        self.byte_id = {int(self.text_of[i][3:5], 16): i for i in range(len(self.text_of)) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        self.bytes_of = [b"" if sp.is_control(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(self.text_of)]
        self.bytes_of[self.unknown] = " ⁇ ".encode()
        for b, i in self.byte_id.items():
            self.bytes_of[i] = bytes([b])
        self.longest = max(map(len, self.id_of))
        self.normalize = sp.normalize
        self.sp = sp
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.id_of):
            raise ValueError("a piece of this model goes on across a space")
        self.stretches = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        #: pieces by character: a beginning's node has the next characters' nodes, and at "" its first character and the longer pieces that it begins with, by length
        self.root: dict = {}
        for piece in sorted(self.id_of, key=len):
            node = self.root
            for c in piece:
                node = node.setdefault(c, {"": node.get("", (c,))})
            if len(piece) > 1:
                node[""] += (piece,)
        self.stands: dict[str, dict[str, bool]] = {}
        self.tested = 0
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def stand(self, a: str, b: str) -> bool:
        """Whether merging a + b alone, the best-scored adjacent pair first and from the left among equals, ends at a and b."""
        part, score, none = list(a + b), self.score, float("-inf")
        scores = [score.get(x + y, none) for x, y in zip(part, part[1:])]
        inside = len(a)  # parts of a
        while scores and (top := max(scores)) > none:
            i = scores.index(top)
            if i == inside - 1:
                return False
            if i < inside:
                inside -= 1
            part[i] += part.pop(i + 1)
            del scores[i]
            if i:
                scores[i - 1] = score.get(part[i - 1] + part[i], none)
            if i < len(scores):
                scores[i] = score.get(part[i] + part[i + 1], none)
        return len(part) == 2

    def edge(self, a: str, b: str) -> bool:
        """Whether the edge from token a to token b weighs 0; no token reaches over a space, so none constrains one there."""
        if not a or (b[0] == SPACE and a[-1] != SPACE):
            return True
        row = self.stands.get(a)
        if row is None:
            row = self.stands[a] = {}
        ok = row.get(b)
        if ok is None:
            ok = row[b] = self.stand(a, b)
            self.tested += 1
            if self.tested > 4 * REMEMBERED:
                self.stands.clear()
                self.tested = 0
        return ok

    def tokens_at(self, text: str, i: int) -> Iterator[str]:
        """Tokens that start at i; a character that is no piece is one by itself."""
        node = self.root.get(text[i])
        if node is None:
            yield text[i]
            return
        for c in text[i + 1 : i + self.longest]:
            deeper = node.get(c)
            if deeper is None:
                break
            node = deeper
        yield from node[""]

    def forward(self, text: str, begin: int, last: str, stop: int) -> dict[int, dict[str, tuple[int, str]]]:
        """end -> last token there -> (where the token before it ends, that token): all paths from `last`, which ends at begin, of tokens that start before stop."""
        reached: dict[int, dict[str, tuple[int, str]]] = {begin: {last: (-1, "")}}
        for i in range(begin, stop):
            if i in reached:
                for t in self.tokens_at(text, i):
                    for a in reached[i]:
                        if self.edge(a, t):
                            reached.setdefault(i + len(t), {}).setdefault(t, (i, a))
                            break
        return reached

    def tokens(self, s: str) -> list[str]:
        """The path over a stretch whose left end has one state: then each place has at most one last token.

        The longest token goes first; a place that no path leads on from is left once and for all, so each place is gone on from once.
        """
        n, root, edge, stands = len(s), self.root, self.edge, self.stands
        out: list[str] = []
        ways: list[tuple[tuple[str, ...], int]] = []
        dead: set[int] = set()
        i, a = 0, ""
        while i < n:
            node = root.get(s[i])
            if node is None:
                way: tuple[str, ...] = (s[i],)
            else:
                for c in s[i + 1 :]:
                    deeper = node.get(c)
                    if deeper is None:
                        break
                    node = deeper
                way = node[""]
            left = len(way)
            while True:
                tested = stands.get(a, _NONE)
                while left:
                    left -= 1
                    t = way[left]
                    if i + len(t) not in dead and (tested.get(t) or t not in tested and edge(a, t)):
                        break
                else:
                    dead.add(i)
                    i -= len(out.pop())
                    (way, left), a = ways.pop(), out[-1] if out else ""
                    continue
                break
            out.append(t)
            ways.append((way, left))
            i, a = i + len(t), t
        return out

    def trace(self, reached: dict, end: int, last: str, begin: int) -> list[str]:
        out = []
        while end > begin:
            out.append(last)
            end, last = reached[end][last]
        return out[::-1]

    def ids(self, tokens: list[str]) -> bytes:
        out = array("I")
        for t in tokens:
            i = self.id_of.get(t)
            if i is not None:
                out.append(i)
            elif self.byte_id:
                out.extend(self.byte_id[b] for b in t.encode("utf-8", "replace"))
            else:
                out.append(self.unknown)
        return out.tobytes()

    def stretch(self, s: str) -> bytes:
        """Ids of a stretch between two spaces: a chunk whose both ends have one state."""
        got = self.known.get(s)
        if got is None:
            got = self.older.get(s)
            if got is None:
                got = self.ids(self.tokens(s))
            if len(s) <= REMEMBERED_CHARS:
                if len(self.known) >= REMEMBERED:
                    self.older, self.known = self.known, {}
                self.known[s] = got
        return got

    def between(self, text: str) -> bytes:
        parts = self.stretches.findall(text)
        got = list(map(self.known.get, parts))
        if None in got:
            got = [self.stretch(p) if g is None else g for p, g in zip(parts, got)]
        return b"".join(got)

    # a chunk: text[left:right] of a longer text, with margins of `longest` characters on both sides

    def states(self, text: str, at: int) -> list[State]:
        """Tokens that hold the character before `at`: what may lie across this boundary."""
        out = []
        for i in range(max(0, at - self.longest), at):
            out += [(i - at, i + len(t) - at, t) for t in self.tokens_at(text, i) if i + len(t) >= at]
        return out

    def _fixed(self, text: str, left: int, right: int) -> tuple[int, int] | None:
        """First and last place of the chunk where a space follows something else, far enough from the left end: every path passes there."""
        at = [m.start() + 1 for m in re.finditer(f"[^{SPACE}]{SPACE}", text[left:right])]
        at = [left + a for a in at if a >= self.longest]
        return (at[0], at[-1]) if at else None

    def matrix(self, text: str, left: int, right: int, first: bool, last: bool) -> dict[State, dict[State, float]]:
        """State across the left end -> state across the right end -> weight; entries of minus infinity are left out."""
        ins = [EDGE] if first else self.states(text, left)
        outs = {EDGE} if last else set(self.states(text, right))
        fixed = self._fixed(text, left, right)
        tail = self._ends(self.forward(text, fixed[1], "", right), right, outs) if fixed else None
        rows: dict[State, dict[State, float]] = {}
        for s in ins:
            begin = left + s[1]
            if fixed:
                rows[s] = dict.fromkeys(tail, 0.0) if begin <= fixed[0] and fixed[0] in self.forward(text, begin, s[2], fixed[0]) else {}
            elif begin >= right:  # the token reaches over the whole chunk
                o = (left + s[0] - right, begin - right, s[2]) if not last else EDGE
                rows[s] = {o: 0.0} if o in outs and (not last or begin == right) else {}
            else:
                rows[s] = dict.fromkeys(self._ends(self.forward(text, begin, s[2], right), right, outs), 0.0)
        return rows

    @staticmethod
    def _ends(reached: dict, right: int, outs: set[State]) -> list[State]:
        if EDGE in outs:
            return [EDGE] if right in reached else []
        return [o for e, by in reached.items() if e >= right for t in by if (o := (e - len(t) - right, e - right, t)) in outs]

    def path(self, text: str, left: int, right: int, enter: State, leave: State) -> bytes:
        """Ids of the tokens that start inside the chunk, on the path between the two states."""
        begin = left + enter[1]
        end = right + leave[1]
        if begin >= right:
            return b""
        fixed = self._fixed(text, left, right)
        if fixed and begin <= fixed[0]:
            head = self.forward(text, begin, enter[2], fixed[0])
            out = self.ids(self.trace(head, fixed[0], next(iter(head[fixed[0]])), begin)) + self.between(text[fixed[0] : fixed[1]])
            begin, enter_token = fixed[1], ""
        else:
            out, enter_token = b"", enter[2]
        reached = self.forward(text, begin, enter_token, right)
        return out + self.ids(self.trace(reached, end, leave[2] or next(iter(reached[end])), begin))

    def normal(self, text: str | None) -> str:
        return self.normalize(text) if text else ""

    def encode(self, text: str | None) -> bytes:
        """Little-endian 32-bit ids of a text in one chunk."""
        return self.between(self.normal(text))

    def decode(self, ids: bytes) -> str:
        text = b"".join(map(self.bytes_of.__getitem__, array("I", ids))).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def product(a: dict[State, dict[State, float]], b: dict[State, dict[State, float]]) -> dict[State, dict[State, float]]:
    """The max-plus product of two chunks' matrices: associative, so neighbours may be combined in any order."""
    out: dict[State, dict[State, float]] = {}
    for i, row in a.items():
        best: dict[State, float] = {}
        for k, x in row.items():
            for j, y in b.get(k, {}).items():
                best[j] = max(best.get(j, float("-inf")), x + y)
        out[i] = best
    return out


def boundary_states(matrices: list[dict[State, dict[State, float]]]) -> list[State]:
    """The states of the best path at all boundaries, from the text's start to its end: products of halves, then of their halves."""

    def within(lo: int, hi: int, enter: State, leave: State) -> list[State]:
        if hi - lo == 1:
            return []
        mid = (lo + hi) // 2
        row, right = whole[lo, mid][enter], whole[mid, hi]
        k = max((k for k in row if leave in right.get(k, {})), key=lambda k: row[k] + right[k][leave])
        return [*within(lo, mid, enter, k), k, *within(mid, hi, k, leave)]

    whole: dict[tuple[int, int], dict] = {}

    def build(lo: int, hi: int) -> dict:
        mid = (lo + hi) // 2
        whole[lo, hi] = matrices[lo] if hi - lo == 1 else product(build(lo, mid), build(mid, hi))
        return whole[lo, hi]

    build(0, len(matrices))
    return [EDGE, *within(0, len(matrices), EDGE, EDGE), EDGE]


_scans: dict[str, PieceScan] = {}


def scan(path: str) -> PieceScan:
    if path not in _scans:
        _scans[path] = PieceScan(path)
    return _scans[path]


def encode(docs: DataFrame, model: str, chunk: int = CHUNK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, text, ids): every row's whole text and its ids, little-endian 32-bit numbers in one binary.

    model: path of a SentencePiece BPE model, the same on all executors. Texts of up to `chunk` characters are one chunk each and need
    no shuffle. Longer ones are dealt out chunk by chunk; a document's matrices (a few states each) meet in one task, its text
    never does before its ids are put together. Null and empty texts have no ids; equal rows each get theirs; null ids stay.
    """
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    giant = F.length("text") > chunk

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scan(model)
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([s.encode(t) for t in b.column(1).to_pylist()], pa.binary())], names=["id", "text", "ids"])

    short = rows.where(F.coalesce(~giant, F.lit(True))).mapInArrow(small, f"id {kind}, text string, ids binary")
    # written, so that all texts aren't read once for each use of it
    large = written(rows.where(giant).groupBy("id", F.xxhash64("text").alias("key"), "text").agg(F.count(F.lit(1)).alias("times")), "giants")

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scan(model)
        for b in slices(batches):
            for i, key, text in zip(b.column(0), b.column(1), b.column(2)):
                t = s.normal(text.as_py())
                n = -(-len(t) // chunk)
                for k in range(n):
                    a, z = k * chunk, min(len(t), (k + 1) * chunk)
                    lo = max(0, a - s.longest)
                    yield pa.RecordBatch.from_arrays([pa.array([x], c) for x, c in ((i.as_py(), i.type), (key.as_py(), pa.int64()), (k, pa.int32()), (k == n - 1, pa.bool_()), (t[lo : z + s.longest], pa.string()), (a - lo, pa.int32()), (z - lo, pa.int32()))], names=["id", "key", "k", "last", "part", "left", "right"])

    parts = large.select("id", "key", "text").mapInArrow(chunks, f"id {kind}, key long, k int, last boolean, part string, left int, right int").repartition(shuffle_partitions(docs.sparkSession), "id", "key", "k")

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scan(model)
        for b in slices(batches):
            m = [pickle.dumps(s.matrix(t, a, z, k == 0, last)) for k, last, t, a, z in zip(*(b.column(c).to_pylist() for c in range(2, 7)))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(m, pa.binary())], names=["id", "key", "k", "m"])

    def joined(table: pa.Table) -> pa.Table:
        table = table.sort_by("k")
        states = boundary_states([pickle.loads(m.as_py()) for m in table.column("m")])  # noqa: S301  our own, from the step before
        ends = [pickle.dumps(p) for p in zip(states, states[1:])]
        return pa.table([table.column("id"), table.column("key"), table.column("k"), pa.array(ends, pa.binary())], names=["id", "key", "k", "ends"])

    made = parts.mapInArrow(matrices, f"id {kind}, key long, k int, m binary").groupBy("id", "key").applyInArrow(joined, f"id {kind}, key long, k int, ends binary")
    same = [parts["id"].eqNullSafe(made["id"]), parts["key"] == made["key"], parts["k"] == made["k"]]
    both = parts.join(made, same).select(parts["id"], parts["key"], parts["k"], "part", "left", "right", "ends")

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scan(model)
        for b in slices(batches):
            ids = [s.path(t, a, z, *pickle.loads(e)) for t, a, z, e in zip(*(b.column(c).to_pylist() for c in range(3, 7)))]  # noqa: S301
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(ids, pa.binary())], names=["id", "key", "k", "ids"])

    ids = both.mapInArrow(traced, f"id {kind}, key long, k int, ids binary").groupBy("id", "key").agg(F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("p"))
    ids = ids.select(F.col("id").alias("_id"), F.col("key").alias("_key"), F.aggregate("p", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"])).alias("ids"))
    whole = large.join(ids, large["id"].eqNullSafe(ids["_id"]) & (large["key"] == ids["_key"]))
    whole = whole.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).select("id", "text", "ids")
    return short.unionByName(whole).withColumnRenamed("id", id_col).withColumnRenamed("text", text_col)


def decode(encoded: DataFrame, model: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """encoded plus the text of its ids: pieces put together, byte pieces as UTF-8, without the leading space. Null ids: null. out must be a new name."""
    at = encoded.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scan(model)
        for b in slices(batches):
            texts = [None if x is None else s.decode(x) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, out])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField(out, T.StringType())]))
