"""Operator 4: URL filters: longest fitting rule, else naive Bayes over host and path words that unigram Viterbi segments."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_written, slices, written

ALLOW, BLOCK = "allow", "block"
#: Names whose scores go out with the tasks, the most frequent ones, and the longest such name; all others are looked up by a join.
FREQUENT, FREQUENT_LETTERS = 50_000, 100
#: Copies of a looked-up table among which a very common key's rows are dealt.
SALTS = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """verdict for a host and its subdomains, for paths that start with path; name as in `example.com/en/`."""

    verdict: str
    name: str

    @property
    def host(self) -> str:
        return self.name.partition("/")[0]

    @property
    def path(self) -> str:
        return self.name[len(self.host) :]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host after the first :// up to /, ?, # or the end, A-Z lower-cased; the path from there up to ?, # or the end. Null or no ://: both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def fitting_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Name of the longest rule that fits, or null: plain expressions, whatever the table's size."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(r.name)).otherwise(out)
    return out


def names_in(text: str) -> Column:
    """The runs of letters a-z of a column in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)"), 1)


def segments(name: str, known: list[tuple[int, int, float]], total: float) -> list[str]:
    """The likeliest split of a name into words: Viterbi over unigrams.

    known: (start, length, log probability) of each known word in it. Any other stretch costs 1 / total and a factor of ten a
    letter. Among equally likely splits the one whose last word is longest. Linear in the name and its known words.
    """
    by_end: dict[int, list[tuple[int, float]]] = {}
    for i, n, p in known:
        by_end.setdefault(i + n, []).append((i, p))
    ten, new = math.log(10), -math.log(total)
    best, back = [0.0] + [-math.inf] * len(name), [0] * (len(name) + 1)
    opened, opened_at = 0.0, 0  # the best start of an unknown stretch: what its letters cost counted from the name's start
    for i in range(1, len(name) + 1):
        best[i], back[i] = opened + new - ten * i, opened_at
        for j, p in sorted(by_end.get(i, ())):
            if best[j] + p > best[i]:
                best[i], back[i] = best[j] + p, j
        if best[i] + ten * i > opened:
            opened, opened_at = best[i] + ten * i, i
    out, i = [], len(name)
    while i:
        out.append(name[back[i] : i])
        i = back[i]
    return out[::-1]


def _looked_up(rows: DataFrame, by: str, salt: str, other: DataFrame, key: str, how: str) -> DataFrame:
    """rows joined with other (one row a key), a very common key's rows dealt among SALTS copies by a hash of the salt column."""
    dealt = rows.withColumn("_s", F.pmod(F.xxhash64(salt), F.lit(SALTS)))
    copies = other.withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(copies, (F.col(by) == F.col(key)) & (F.col("_s") == F.col("_t")), how).drop("_s", "_t")


@dataclass
class UrlModel:
    """scores: (name, h, p), what a name adds to the log odds of block against allow in a host and in a path; the most frequent ones also at hand."""

    prior: float
    scores: DataFrame
    frequent: dict[str, tuple[float, float]]


def _ruled(pages: DataFrame, rules: list[Rule], id_col: str, url_col: str) -> DataFrame:
    host, path = host_and_path(pages[url_col])
    rows = pages.select(pages[id_col].alias("id"), host.alias("host"), path.alias("path"))
    return rows.withColumn("rule", fitting_rule(F.col("host"), F.col("path"), rules))


def segmented(words: DataFrame) -> DataFrame:
    """(name, parts) of each of words (w, n): every name split by all names that more than one host has, with n as their frequency.

    A name's substrings of the lengths that known words have are looked up by a join: the dictionary may be of any size.
    """
    total = float(words.agg(F.sum("n")).first()[0] or 1)
    known = words.where("n > 1").select("w", F.log(F.col("n") / total).alias("lp"))
    lengths = sorted(r[0] for r in known.select(F.length("w")).distinct().collect())

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 100):
            for name in b.column(0).to_pylist():
                for n in lengths:
                    if n > len(name):
                        break
                    for lo in range(0, len(name) - n + 1, 50_000):
                        at = range(lo, min(len(name) - n + 1, lo + 50_000))
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at, pa.int32()), pa.array([name[i : i + n] for i in at])], names=["name", "at", "part"])

    def batched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in stretches(batches):
            held.append(b)
            rows += b.num_rows
            if rows > 20_000:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, rows = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    parts = words.select("w").mapInArrow(batched, "name string, at int, part string")
    found = _looked_up(parts, "part", "name", known, "w", "inner")
    found = found.groupBy("name").agg(F.collect_list(F.struct("at", F.length("part").alias("n"), "lp")).alias("known"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1000):
            names = b.column(0).to_pylist()
            out = [segments(name, [(k["at"], k["n"], k["lp"]) for k in known or ()], total) for name, known in zip(names, b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(out, pa.list_(pa.string()))], names=["name", "parts"])

    return words.select(F.col("w").alias("name")).join(found, "name", "left").select("name", "known").mapInArrow(split, "name string, parts array<string>")


def fit_urls(pages: DataFrame, rules: list[Rule], sample: int = 50_000, id_col: str = "page_id", url_col: str = "url") -> UrlModel:
    """Words from all urls; naive Bayes from urls that a rule decides.

    A word counts once for each different host that has it, in host or path, so that a host with a third of all pages doesn't make
    its whole name a word. All words count, however many and however long; they stay tables. Naive Bayes learns from at most
    `sample` urls with a rule, those with the smallest hash. The driver sees sums and the FREQUENT scores.
    """
    rows = _ruled(pages, rules, id_col, url_col)
    each = rows.select("host", F.explode(F.concat(names_in("host"), names_in("path"))).alias("w")).groupBy("host", "w").agg(F.count(F.lit(1)).alias("c"))
    words = written(each.groupBy("w").agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("times")), "words")
    named = written(segmented(words), "segments")
    verdict = F.create_map(*[F.lit(x) for r in rules for x in (r.name, int(r.verdict == BLOCK))])[F.col("rule")] if rules else F.lit(None).cast("int")
    ruled = written(rows.where("rule is not null").select("host", "path", verdict.alias("y")).orderBy(F.xxhash64("host", "path", "id")).limit(sample), "ruled")
    n = {r["y"]: r["n"] for r in ruled.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    both = F.concat(F.transform(names_in("host"), lambda w: F.struct(F.lit("h").alias("place"), w.alias("w"))), F.transform(names_in("path"), lambda w: F.struct(F.lit("p").alias("place"), w.alias("w"))))
    seen = _looked_up(ruled.select("y", "host", "path", F.explode(both).alias("x")).select("y", "x.place", "x.w", F.concat("host", "path").alias("url")), "w", "url", named, "name", "inner")
    counts = written(seen.select("y", "place", F.explode("parts").alias("part")).groupBy("place", "part").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg")), "counts")
    pos, neg, different = counts.agg(F.sum("pos"), F.sum("neg"), F.count(F.lit(1))).first()
    if n.get(0) and n.get(1):
        odds = F.log((F.col("pos") + 1) / (pos + different)) - F.log((F.col("neg") + 1) / (neg + different))
        prior = math.log(n[1] / n[0])
    else:
        odds, prior = F.lit(0.0), 1.0 if n.get(1) else 0.0
    at = lambda place: F.max(F.when(F.col("place") == place, odds))
    by_part = counts.groupBy("part").agg(at("h").alias("h"), at("p").alias("p")).withColumnRenamed("part", "_part")
    pieces = _looked_up(named.select("name", F.explode("parts").alias("part")), "part", "name", by_part, "_part", "left")
    scores = written(pieces.groupBy("name").agg(F.sum(F.coalesce("h", F.lit(0.0))).alias("h"), F.sum(F.coalesce("p", F.lit(0.0))).alias("p")), "scores")
    top = words.where(F.length("w") <= FREQUENT_LETTERS).orderBy(F.desc("times"), "w").limit(FREQUENT).join(scores, F.col("w") == F.col("name")).select("name", "h", "p")
    frequent = {r["name"]: (r["h"], r["p"]) for r in top.collect()}
    drop_written(words, named, ruled, counts)
    return UrlModel(prior, scores, frequent)


def judge_urls(pages: DataFrame, rules: list[Rule], model: UrlModel, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id_col, host, path, rule, verdict) of every row.

    Rules and urls with frequent names only are decided in one pass; urls with other names look these up by a join, once for each
    different host and path. A url that is null or has no :// has an empty host and path, fits no rule and is judged by the prior
    alone; urls of any length are read whole; rules tie only if they are equal; null ids and repeated rows are judged like any
    other; other columns are not read. Without rules of both verdicts the method allows (blocks) everything.
    """
    spark = pages.sparkSession
    sent = spark.sparkContext.broadcast((model.prior, model.frequent, {r.name: r.verdict for r in rules}))
    rows = _ruled(pages, rules, id_col, url_col).withColumn("h", F.when(F.col("rule").isNull(), names_in("host"))).withColumn("p", F.when(F.col("rule").isNull(), names_in("path")))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prior, known, by_rule = sent.value

        def of(rule: str | None, h: list[str], p: list[str]) -> str | None:
            if rule is not None:
                return by_rule[rule]
            x, y = [known.get(w) for w in h], [known.get(w) for w in p]
            return None if None in x or None in y else BLOCK if round(prior + sum(s[0] for s in x) + sum(s[1] for s in y), 9) > 0 else ALLOW

        for b in slices(batches, 5000):
            v = [of(*x) for x in zip(*(b.column(k).to_pylist() for k in (3, 4, 5)))]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(v, pa.string())], names=[*b.schema.names[:4], "verdict"])

    judged = written(rows.mapInArrow(run, f"id {kind}, host string, path string, rule string, verdict string"), "judged")
    left = judged.where("verdict is null").select("host", "path").distinct()
    one = lambda place: F.transform(names_in("host" if place == "h" else "path"), lambda w: F.struct(w.alias("w"), F.lit(place).alias("place")))
    looked = _looked_up(left.select("host", "path", F.concat("host", "path").alias("url"), F.explode(F.concat(one("h"), one("p"))).alias("x")).select("host", "path", "url", "x.w", "x.place"), "w", "url", model.scores, "name", "left")
    total = F.lit(float(model.prior)) + F.sum(F.coalesce(F.when(F.col("place") == "h", F.col("h")).otherwise(F.col("p")), F.lit(0.0)))
    late = looked.groupBy("host", "path").agg(F.when(F.round(total, 9) > 0, BLOCK).otherwise(ALLOW).alias("late"))
    out = judged.where("verdict is not null").unionByName(judged.where("verdict is null").drop("verdict").join(late, ["host", "path"]).withColumnRenamed("late", "verdict").select("id", "host", "path", "rule", "verdict"))
    return out.withColumnRenamed("id", id_col)
