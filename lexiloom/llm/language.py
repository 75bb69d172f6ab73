"""Operator 7: language identification by a blended-spectrum string kernel, Nyström landmarks and kernel ridge regression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept_rows, slices

#: Bins of the hashed n-grams of 1, 2 and 3 letters: the kernel is defined on which bins a text has.
BINS = (1024, 4096, 8192)
#: Weight of each n-gram length in the blended kernel.
BLEND = (0.2, 0.3, 0.5)
#: Letters of a stretch. Presence saturates in long texts, so a text is taken as stretches of about this length, whose kernel values are averaged.
STRETCH = 2000
#: Texts whose kernel rows are multiplied with the landmarks' weights at once.
BATCH = 64
UNDETERMINED = "und"
#: What any text has to score to count as one of the languages; characters from which more is asked.
LEAST, SURE = 0.05, 150

_SPACE = 32
_fold: np.ndarray | None = None


def _folded_letters() -> np.ndarray:
    """Code point up to U+FFFF -> its lower-case letter, or the space for what is no letter."""
    global _fold
    if _fold is None:
        one = lambda c: ord(c.lower()) if len(c.lower()) == 1 and ord(c.lower()) < 0x10000 else ord(c)
        _fold = np.array([one(c) if (c := chr(i)).isalpha() else _SPACE for i in range(0x10000)], np.uint32)
    return _fold


def letters(text: str) -> np.ndarray:
    """The text's letters in lower case, each run of anything else as one space, with a space at both ends. No letter: empty."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    high = points > 0xFFFF
    x = _folded_letters()[np.where(high, _SPACE, points)]
    if high.any():
        at = np.flatnonzero(high)
        x[at] = [p if chr(p).isalpha() else _SPACE for p in points[at].tolist()]
    x = np.concatenate(([_SPACE], x, [_SPACE])).astype(np.uint32)
    x = x[np.concatenate(([True], (x[1:] != _SPACE) | (x[:-1] != _SPACE)))]
    return x if len(x) > 1 else x[:0]


def _bins(x: np.ndarray) -> np.ndarray:
    out = np.zeros(sum(BINS), np.float32)
    base = 0
    for n, bins in enumerate(BINS, 1):
        if len(x) >= n:
            h = x[: len(x) - n + 1].astype(np.uint32)
            for j in range(1, n):
                h = h * np.uint32(0x01000193) + x[j : len(x) - n + 1 + j]
            h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            own = out[base : base + bins]
            own[(h >> np.uint32(12)) % np.uint32(bins)] = 1
            own *= np.sqrt(BLEND[n - 1] / max(1, np.count_nonzero(own)))
        base += bins
    return out


def presence(text: str | None) -> np.ndarray | None:
    """Which bins the n-grams fall into, each length's bins divided by the root of their number; None without a letter.

    A text of several stretches gets their mean, so that its kernel with a landmark is the mean over all its stretches.
    """
    x = letters(text) if text else np.empty(0, np.uint32)
    if not len(x):
        return None
    parts = max(1, round(len(x) / STRETCH))
    edges = np.linspace(0, len(x), parts + 1).astype(int).tolist()
    out = _bins(x[: edges[1] + 2])
    for a, z in zip(edges[1:-1], edges[2:]):
        out += _bins(x[a : z + 2])
    return out / np.float32(parts) if parts > 1 else out


@dataclass
class LanguageModel:
    languages: list[str]
    landmarks: np.ndarray  # bins x landmarks
    weights: np.ndarray  # landmarks x languages
    unlike: float = LEAST  # what texts of SURE characters and more have to score to count as one of the languages

    def kernel(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(texts x landmarks, which texts have a letter), by batched matrix products."""
        out, has = np.zeros((len(texts), self.landmarks.shape[1]), np.float32), np.zeros(len(texts), bool)
        for i in range(0, len(texts), BATCH):
            rows = [presence(t) for t in texts[i : i + BATCH]]
            at = [k for k, r in enumerate(rows) if r is not None]
            if at:
                out[i + np.array(at)] = np.stack([rows[k] for k in at]) @ self.landmarks
                has[i + np.array(at)] = True
        return out, has

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if not self.languages:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts)
        k, has = self.kernel(texts)
        y = k @ self.weights
        best = y.argmax(1)
        score = np.clip(y[np.arange(len(y)), best], 0, 1).astype(float)
        return [self.languages[b] if ok else UNDETERMINED for b, ok in zip(best, has)], np.where(has, score, 0.0).tolist()


def fit_language(docs: DataFrame, per_language: int = 400, landmarks: int = 160, ridge: float = 1e-3, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Learn from rows with a language and a text: at most per_language rows of each, those with the smallest hash of their id.

    That bound keeps the sample small however large the table: languages (a few hundred at most) times per_language kernel rows of
    `landmarks` numbers reach the driver, and the texts of the landmarks themselves. Landmarks are dealt evenly to the languages.
    No row to learn from: a model that answers `und`.
    """
    rows = docs.select(docs[id_col].cast("string").alias("id"), docs[text_col].alias("text"), docs[lang_col].alias("lang")).where("text is not null and lang is not null")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return LanguageModel([], np.zeros((sum(BINS), 0), np.float32), np.zeros((0, 0)))
    # a hash threshold a language, a little high, then an exact cut of the ids by hash
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, (1.5 * per_language + 50) / n))])
    hashed = F.xxhash64("id")
    picked = rows.where(F.pmod(hashed, F.lit(1 << 30)) < share[F.col("lang")] * float(1 << 30)).select("lang", hashed.alias("h"))
    taken: dict[str, list[int]] = {}
    for r in sorted((r["lang"], r["h"]) for r in picked.collect()):
        taken.setdefault(r[0], []).append(r[1])
    spark = docs.sparkSession
    deal = max(1, landmarks // len(taken))
    chosen = [(lang, h, i < deal) for lang, hs in sorted(taken.items()) for i, h in enumerate(sorted(set(hs))[:per_language])]
    sample = rows.withColumn("h", hashed).join(F.broadcast(spark.createDataFrame(chosen, "lang string, h long, landmark boolean")), ["lang", "h"]).select("lang", "h", "landmark", "text")
    texts = sorted({(r["lang"], r["h"], r["text"]) for r in sample.where("landmark").collect()})
    found = [(lang, p) for lang, _, t in texts if (p := presence(t)) is not None]
    marks, of_mark = [p for _, p in found], np.array([lang for lang, _ in found])
    if not marks:
        return LanguageModel([], np.zeros((sum(BINS), 0), np.float32), np.zeros((0, 0)))
    model = LanguageModel(sorted(taken), np.stack(marks, 1), np.zeros((len(marks), len(taken)), np.float32))

    def kernel_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = b.column(1).to_pylist()
            k, has = model.kernel(texts)
            rows = [r.tobytes() for r in k[has].astype("<f4")]
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(has)), pa.array([len(t) >= SURE for t, h in zip(texts, has) if h], pa.bool_()), pa.array(rows, pa.binary())], names=["lang", "sure", "k"])

    got = sample.select("lang", "text").mapInArrow(kernel_rows, "lang string, sure boolean, k binary").collect()
    got.sort(key=lambda r: (r["lang"], bytes(r["k"])))
    k = np.stack([np.frombuffer(bytes(r["k"]), "<f4") for r in got]).astype(np.float64)
    y = np.array([[r["lang"] == lang for lang in model.languages] for r in got], float)
    weight = y @ (1 / np.sqrt(y.sum(0).clip(1)))  # languages weigh alike, however often they occur
    kw, target = k * weight[:, None], y * weight[:, None]
    mm = model.landmarks.T.astype(np.float64) @ model.landmarks
    def solved(rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        some = kw[np.ix_(rows, cols)]
        return np.linalg.solve(some.T @ some + ridge * float((weight[rows] ** 2).sum()) * (mm[np.ix_(cols, cols)] + 1e-6 * np.eye(cols.sum())), some.T @ target[rows])

    every, all_marks = np.ones(len(k), bool), np.ones(len(marks), bool)
    model.weights = solved(every, all_marks).astype(np.float32)
    # what texts score in a model that has never met their language; asked for is what nine of ten of them miss, but hardly any known text
    sure = np.array([r["sure"] for r in got])
    strange, known = [0.0], (k @ model.weights).max(1)[sure]
    for j, lang in enumerate(model.languages):
        rows, cols = y[:, j] == 0, of_mark != lang
        if rows.any() and cols.any():
            strange += (k[~rows & sure][:, cols] @ solved(rows, cols)).max(1).tolist()
    if len(known):
        model.unlike = max(LEAST, min(float(np.quantile(strange, 0.9)), 0.95 * float(np.quantile(known, 0.001))))
    return model


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score) of every row, from its whole text alone, in one pass without a shuffle.

    `und` with score 0 for texts that are null or have no letter; equal texts, repeated rows too, get equal answers; very long texts
    are read whole, in stretches whose kernel values are averaged; null ids stay null; other columns are neither read nor returned. The model (a few MB, whatever the data) goes out with the tasks.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            lang, score = sent.value.predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["id", "lang_pred", "score"])

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def keep_identified(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, in a language that the model knows: not `und`, and alike enough to the landmarks.

    Short texts only have to score LEAST; a text in another script scores 0. From SURE characters on, the model asks for more: what
    texts in languages that it was kept from while fitting mostly don't reach.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def keep(texts: list[str | None]) -> list[bool]:
        m = sent.value
        return [lang != UNDETERMINED and score >= (m.unlike if len(t or "") >= SURE else LEAST) for t, lang, score in zip(texts, *m.predict(texts))]

    return kept_rows(docs, text_col, keep)
