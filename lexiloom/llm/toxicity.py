"""Operator 9: toxicity by a weighted lexicon, matched by Aho-Corasick in folded text, with exception phrases."""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept_rows, slices

# Insults that count from the start, phrases in which such words mean something else, and the folding.
SEED_WORDS = ("idiot", "imbecile", "moron", "stupid", "scum", "trash", "loser", "clown", "pathetic", "disgusting", "worthless", "vermin", "abschaum", "trottel", "connard", "crétin", "débile", "estúpido", "imbécil", "escoria")
SEED_EXCEPTIONS = ("trash can", "trash bin", "clown fish", "scum line")
HOMOGLYPHS = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ј": "j", "ѕ": "s", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "α": "a", "ε": "e", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "ν": "v", "ι": "i", "κ": "k", "χ": "x"}
OWN_LETTERS = "àáâãäåæçèéêëìíîïñòóôõöøùúûüýßœ"
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "|": "i", "l": "i"}

#: Letters of the shortest and longest word beginnings that may become lexicon entries.
SHORTEST, LONGEST = 3, 12
#: Weight of a seed word that the labels neither support nor contradict.
SEED_WEIGHT = 4.0
THRESHOLD = 0.3


class _Folding(dict):
    """Code point -> what stands for it in folded text; filled as characters come."""

    def __missing__(self, point: int) -> str:
        out = ""
        c = chr(point).lower()
        for c in c if c in OWN_LETTERS else unicodedata.normalize("NFKD", c):
            c = HOMOGLYPHS.get(c, c)
            c = SUBSTITUTES.get(c, c)
            if unicodedata.category(c) not in ("Mn", "Cf"):
                out += c if c.isalnum() else " "
        self[point] = out
        return out


_folding = _Folding()


def fold(text: str | None) -> str:
    """Lower case; look-alikes, digits and signs as the Latin letters they stand for (l as i); the rest as single spaces; a space at both ends.

    Accented letters that western European languages spell with stay themselves: there they tell words apart.
    """
    return " " + " ".join((text or "").translate(_folding).split()) + " "


@dataclass
class ToxicityModel:
    """entries: folded word beginning -> weight; exceptions: folded phrases; coefficients of (1, total, density)."""

    entries: dict[str, float]
    exceptions: list[str]
    coefficients: list[float] = field(default_factory=lambda: [-3.0, 1.0, 0.5])
    _machine: object = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_machine": None}

    @property
    def machine(self) -> ahocorasick.Automaton:
        if self._machine is None:
            self._machine = ahocorasick.Automaton()
            for e, w in self.entries.items():
                self._machine.add_word(f" {e}", (len(e) + 1, w))
            for e in self.exceptions:
                self._machine.add_word(f" {e} ", (len(e) + 2, None))
            if len(self._machine):
                self._machine.make_automaton()
        return self._machine

    def hits(self, folded: str) -> list[tuple[int, float, str]]:
        """(place, weight, entry) of the heaviest entry at each word, without words inside exception phrases."""
        if not len(self.machine):
            return []
        at: dict[int, tuple[float, str]] = {}
        spared: list[tuple[int, int]] = []
        for end, (n, w) in self.machine.iter(folded):
            begin = end - n + 1
            if w is None:
                spared.append((begin, end))
            elif begin not in at or w > at[begin][0]:
                at[begin] = (w, folded[begin + 1 : end + 1])
        out, k, until = [], 0, -1
        spared.sort()
        for p, x in sorted(at.items()):
            while k < len(spared) and spared[k][0] <= p:
                until = max(until, spared[k][1])
                k += 1
            if p >= until:
                out.append((p, *x))
        return out

    def features(self, text: str | None) -> tuple[float, float]:
        folded = fold(text)
        total = sum(w for _, w, _ in self.hits(folded))
        return math.log1p(total), math.log1p(100 * total / max(1, folded.count(" ") - 1))

    def score(self, text: str | None) -> float:
        x, y = self.features(text)
        a, b, c = self.coefficients
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * x + c * y))))


def _g2(pos: float, neg: float, p: float, n: float) -> float:
    """Twice the log likelihood ratio of an entry's counts in p toxic and n other documents, against one common rate."""
    rate = (pos + neg) / (p + n)
    ll = lambda k, m, q: (k * math.log(q) if k else 0.0) + ((m - k) * math.log(1 - q) if m > k else 0.0)
    return 2 * (ll(pos, p, pos / p) + ll(neg, n, neg / n) - ll(pos, p, rate) - ll(neg, n, rate)) if 0 < rate < 1 else 0.0


def log_odds(pos: float, neg: float, p: int, n: int) -> float:
    return math.log((pos + 0.5) / (p + 1)) - math.log((neg + 0.5) / (n + 1))


def choose_entries(counts: dict[str, tuple[int, int]], p: int, n: int, least_g2: float = 16.0, least_weight: float = 1.5) -> dict[str, float]:
    """Word beginnings that mark toxic documents, with log odds as weights: a longer one only where it betters every shorter one.

    least_g2 keeps out what a search over very many beginnings finds by chance. A beginning that always goes on alike in toxic
    documents gives way to its continuation: `dis` must not stand for a single longer word.
    """
    narrowed = {e[:-1] for e, (pos, _) in counts.items() if e[:-1] in counts and pos == counts[e[:-1]][0]}
    out: dict[str, float] = {}
    for e in sorted(counts, key=lambda e: (len(e), e)):
        pos, neg = counts[e]
        if e in narrowed:
            continue
        w = log_odds(pos, neg, p, n)
        if w >= least_weight and _g2(pos, neg, p, n) >= least_g2 and all(out.get(e[:k], -9.0) < w - 0.3 for k in range(SHORTEST, len(e))):
            out[e] = w
    return out


def _fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> list[float]:
    """Newton steps on (1, x1, x2); both classes weigh by their share, slopes are kept from turning negative."""
    a = np.column_stack([np.ones(len(x)), x])
    b = np.array([-3.0, 1.0, 0.0])
    for _ in range(60):
        q = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        grad = a.T @ (q - y) + ridge * np.array([0.0, b[1], b[2]])
        hess = (a * (q * (1 - q) + 1e-9)[:, None]).T @ a + ridge * np.eye(3)
        step = np.linalg.solve(hess, grad)
        b = b - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return [float(v) for v in (b[0], max(b[1], 0.0), max(b[2], 0.0))]


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Learn entries, weights, exception phrases and the score's curve from labelled documents.

    sample: at most so many labelled ids are used, those with the smallest hash (all, where there are fewer); ids with null or
    contradictory labels count as toxic if any label is 1. Only per-beginning counts that pass a support threshold and two numbers
    a sampled document reach the driver. Without labels of both kinds: the seed words with a default curve.
    """
    spark = docs.sparkSession
    ids = labels.select(labels[id_col].alias("id"), labels[label_col].alias("y")).where("id is not null and y is not null").groupBy("id").agg(F.max("y").alias("y"))
    chosen = [(r["id"], int(r["y"] > 0)) for r in ids.orderBy(F.xxhash64("id"), "id").limit(sample).collect()]
    seeds = {fold(w).strip(): SEED_WEIGHT for w in SEED_WORDS}
    exceptions = [fold(w).strip() for w in SEED_EXCEPTIONS]
    if not chosen:
        return ToxicityModel(seeds, exceptions)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).join(F.broadcast(spark.createDataFrame(chosen, f"id {kind}, y int")), "id").select("y", "text")

    def beginnings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How many toxic and other documents have a word that begins so; the empty beginning counts the documents."""
        counts: tuple[Counter, Counter] = (Counter(), Counter())

        def out() -> pa.RecordBatch:
            keys = list(counts[0].keys() | counts[1].keys())
            b = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([counts[1][k] for k in keys], pa.int64()), pa.array([counts[0][k] for k in keys], pa.int64())], names=["e", "pos", "neg"])
            counts[0].clear(), counts[1].clear()
            return b

        for b in slices(batches):
            for y, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = set(fold(text).split())
                counts[y].update({w[:k] for w in words for k in range(SHORTEST, min(len(w), LONGEST) + 1)} | {""})
                if len(counts[0]) + len(counts[1]) > 300_000:
                    yield out()
        yield out()

    total = rows.mapInArrow(beginnings, "e string, pos long, neg long").groupBy("e").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    # a beginning that fewer than three toxic documents have, or that is as common elsewhere, can't become an entry
    got = {r["e"]: (r["pos"], r["neg"]) for r in total.where("e = '' or (pos >= 3 and pos > neg)").collect()}
    p, n = got.pop("", (0, 0))
    learned = choose_entries(got, p, n) if p and n else {}
    entries = {e: w for e, w in seeds.items() if not any(e[:k] in learned for k in range(SHORTEST, len(e) + 1))} | learned
    model = ToxicityModel(entries, exceptions)
    if not (p and n):
        return model

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each sampled document's features, the entries it has, and the two-word phrases around its hits."""
        for b in slices(batches):
            y, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            phrases, entries = [], []
            for t in texts:
                f = fold(t)
                near, own = set(), set()
                for at, _, e in model.hits(f):
                    own.add(e)
                    w = f[max(0, f.rfind(" ", 0, at)) : at + 80].split()[:3]
                    near |= {" ".join(w[:2]), " ".join(w[1:3])}
                phrases.append([x for x in near if " " in x])
                entries.append(list(own))
            x = [model.features(t) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array([v[0] for v in x], pa.float64()), pa.array([v[1] for v in x], pa.float64()), pa.array(entries, pa.list_(pa.string())), pa.array(phrases, pa.list_(pa.string()))], names=["y", "a", "b", "entries", "phrases"])

    schema = "y int, a double, b double, entries array<string>, phrases array<string>"
    # an entry's weight from the words that no heavier entry takes; entries that those words don't bear out go
    own = rows.mapInArrow(marks, schema).select("y", F.explode("entries").alias("e")).groupBy("e").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    seen = own.collect()
    again = {r["e"]: (log_odds(r["pos"], r["neg"], p, n), _g2(r["pos"], r["neg"], p, n)) for r in seen}
    # a seed that the labels say too little about keeps its weight: it takes three other documents to contradict it
    kept = {r["e"] for r in seen if r["e"] not in learned and r["neg"] < 3 and again[r["e"]][1] < 8.0}
    again |= {e: (SEED_WEIGHT, math.inf) for e in entries if e in kept or e not in again}
    model = ToxicityModel({e: again[e][0] for e in entries if again[e][0] >= 2.0 and again[e][1] >= 8.0}, exceptions)
    around = rows.mapInArrow(marks, schema).select("y", F.explode("phrases").alias("e")).groupBy("e").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    model.exceptions = sorted({*exceptions, *(r["e"] for r in around.where("neg >= 3 and neg >= 10 * pos").collect())})
    model._machine = None
    curve = sorted(tuple(r) for r in rows.mapInArrow(marks, schema).select("y", "a", "b").collect())
    x = np.array(curve, float)
    if 0 < x[:, 0].sum() < len(x):
        model.coefficients = _fit_logistic(x[:, 1:], x[:, 0])
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score, predicted) of every row, from its whole text alone, in one pass without a shuffle.

    A null or empty text scores as one without hits; equal texts, repeated rows too, get equal scores; very long texts are read
    whole, in time linear in their length; null ids stay null; other columns are neither read nor returned.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            s = [sent.value.score(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array([int(x >= threshold) for x in s], pa.int32())], names=["id", "score", "predicted"])

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, score double, predicted int").withColumnRenamed("id", id_col)


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that score below the threshold."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return kept_rows(docs, text_col, lambda texts: [sent.value.score(t) < threshold for t in texts])
