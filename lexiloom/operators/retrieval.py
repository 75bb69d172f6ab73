"""Retrieval: inverted index with BM25, exact nearest vectors, rank fusion, context, and the keyword language."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.batches import each
from ..functions.text import fold_text
from .chunking import overlap_len
from .index import KeywordIndex

#: Constant of reciprocal rank fusion; candidates of each retriever.
RRF, CANDIDATES = 60, 50
# Common words of English, Italian, Latin, French and German that a hybrid query leaves out.
STOPWORDS = frozenset("""
a an and are as at be by for from in into is it its of on or that the this to was were with what which who
il lo la i gli le un una di da del della dei delle nel nella e ed che per con non si al alla sul
et in est ad cum de qui quae quod non sed ut
le la les un une des du de et en que qui dans pour sur au aux
der die das und in den von zu mit sich des auf ist im dem nicht ein eine
""".split())


def nearest(vectors: DataFrame, query: DataFrame, k: int = CANDIDATES, candidates: DataFrame | None = None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, score) of the k vectors nearest to the query's one vector (column q), by cosine of unit vectors, within candidates only."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"))
    if candidates is not None:
        rows = rows.join(candidates, "id", "left_semi")
    dot = F.aggregate(F.zip_with("v", "q", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda x, y: x + y)
    return rows.join(F.broadcast(query.limit(1))).select("id", dot.alias("score")).orderBy(F.desc("score"), "id").limit(k)


def ranked(hits: DataFrame) -> DataFrame:
    """hits (at most k rows of a top-k) with their rank."""
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


def fused(semantic: DataFrame, keyword: DataFrame, n: int) -> DataFrame:
    """(id, rrf, semantic_rank, keyword_rank): the n best of both lists by reciprocal ranks; scores don't matter."""
    n = max(1, min(50, n))
    a, b = ranked(semantic).select("id", F.col("rank").alias("semantic_rank")), ranked(keyword).select("id", F.col("rank").alias("keyword_rank"))
    one = lambda c: F.coalesce(F.lit(1.0) / (F.lit(RRF) + F.col(c)), F.lit(0.0))
    both = a.join(b, "id", "full_outer").withColumn("rrf", one("semantic_rank") + one("keyword_rank"))
    return both.orderBy(F.desc("rrf"), F.col("semantic_rank").asc_nulls_last(), F.col("keyword_rank").asc_nulls_last()).limit(n).select("id", "rrf", "semantic_rank", "keyword_rank")


def band_join(left: DataFrame, right: DataFrame, keys: Sequence[str], number: str, before: int, after: int, rename: dict[str, str]) -> DataFrame:
    """Rows of right with left's keys whose number lies within the band around left's, and the distance: an equi-join with a residual range."""
    r = right.select(*keys, F.col(number).alias("_n"), *[F.col(a).alias(b) for a, b in rename.items()])
    d = F.col("_n") - F.col(number)
    return left.join(r, list(keys)).where((d >= -before) & (d <= after)).withColumn("distance", d).drop("_n")


def query_terms(query: str, drop: bool = True) -> list[str]:
    """A natural query's terms, folded: without stop words and single characters, unless nothing else is there."""
    words = [fold_text(w) for w in re.findall(r"\w+", query)]
    kept = [w for w in words if len(w) > 1 and w not in STOPWORDS] if drop else words
    return list(dict.fromkeys(t for w in kept or words for t in re.findall(r"[^\W_]+", w)))


@F.pandas_udf(T.ArrayType(T.StringType()))
def term_lists(query: pd.Series) -> pd.Series:
    """query_terms() of a column of queries."""
    return query.map(lambda q: query_terms(q or ""))


def joined_parts(parts: Sequence[str]) -> str:
    """Chunks as one text: each goes on after what it repeats of the text before it (16 to 2000 characters), else after a blank line."""
    out = ""
    for k, part in enumerate(parts):
        n = overlap_len(out, part, within=2000, probe=16) if k else 0
        out += part[n:] if n >= 16 else f"\n\n{part}" if k else part
    return out


@each(T.StringType())
def stitched_all(parts: list[str | None] | None) -> str | None:
    return None if parts is None else joined_parts([x for x in parts if x is not None])


# the keyword language


class QuerySyntaxError(ValueError):
    pass


@dataclass(frozen=True)
class Phrase:
    words: tuple[str, ...]
    prefix: bool = False
    first: bool = False


@dataclass(frozen=True)
class Near:
    phrases: tuple[Phrase, ...]
    gap: int


@dataclass(frozen=True)
class Op:
    kind: str
    left: object
    right: object


_TOKEN = re.compile(r'\s*(?:(?P<string>"(?:[^"]|"")*")|(?P<sign>[()+*^:,])|(?P<word>[\w\u0080-￿]+))')


def parse(query: str) -> object:
    """AND, OR, NOT in capitals; neighbouring terms bind tightest and mean AND; "phrases", a + b, prefix*, ^first, NEAR(a b, n), parentheses.

    NOT binds tighter than AND, AND than OR. Raises QuerySyntaxError for anything else.
    """
    tokens: list[tuple[str, str]] = []
    at = 0
    while query[at:].strip():
        m = _TOKEN.match(query, at)
        if not m:
            raise QuerySyntaxError(f"can't read {query[at:at + 20]!r}")
        tokens.append((m.lastgroup, m.group(m.lastgroup)))
        at = m.end()
    pos = 0

    def peek(k: int = 0) -> tuple[str, str]:
        return tokens[pos + k] if pos + k < len(tokens) else ("end", "")

    def take(value: str | None = None) -> tuple[str, str]:
        nonlocal pos
        t = peek()
        if t[0] == "end" or value is not None and t != ("sign", value):
            raise QuerySyntaxError(f"expected {value or 'a term'}")
        pos += 1
        return t

    def words_of(t: tuple[str, str]) -> tuple[str, ...]:
        text = t[1][1:-1].replace('""', '"') if t[0] == "string" else t[1]
        return tuple(re.findall(r"[^\W_]+", fold_text(text)))

    def phrase() -> Phrase:
        first = peek() == ("sign", "^")
        if first:
            take()
        if peek()[0] not in ("string", "word"):
            raise QuerySyntaxError("expected a term")
        words = words_of(take())
        while peek() == ("sign", "+"):
            take()
            if peek()[0] not in ("string", "word"):
                raise QuerySyntaxError("expected a term after +")
            words += words_of(take())
        star = peek() == ("sign", "*")
        if star:
            take()
        return Phrase(words, star, first)

    def atom() -> object:
        if peek() == ("sign", "("):
            take()
            inner = either()
            take(")")
            return inner
        if peek() == ("word", "NEAR") and peek(1) == ("sign", "("):
            take(), take()
            parts = [phrase()]
            while peek() not in (("sign", ")"), ("sign", ",")):
                parts.append(phrase())
            gap = 10
            if peek() == ("sign", ","):
                take()
                t = take()
                if not t[1].isdigit():
                    raise QuerySyntaxError("NEAR needs a number")
                gap = int(t[1])
            take(")")
            return Near(tuple(parts), gap)
        if peek()[0] == "word" and peek()[1] in ("AND", "OR", "NOT"):
            raise QuerySyntaxError(f"{peek()[1]} without a term")
        return phrase()

    def row() -> object:
        grouped = peek() == ("sign", "(")
        out = atom()
        while not grouped and (peek()[0] in ("string", "word") and peek()[1] not in ("AND", "OR", "NOT") or peek() == ("sign", "^")):
            out = Op("AND", out, atom())
        return out

    def chain(kind: str, below) -> object:
        out = below()
        while peek() == ("word", kind):
            take()
            out = Op(kind, out, below())
        return out

    def either() -> object:
        return chain("OR", lambda: chain("AND", lambda: chain("NOT", row)))

    if not tokens:
        raise QuerySyntaxError("empty query")
    tree = either()
    if peek()[0] != "end":
        raise QuerySyntaxError(f"unexpected {peek()[1]!r}")
    return tree


def matches(tree: object, index: KeywordIndex) -> DataFrame:
    """(id) of the rows that a parsed query matches; only the postings of its words are read."""

    def starts(p: Phrase) -> DataFrame:
        """(id, s): where the phrase begins."""
        if not p.words:
            return index.postings.select("id", F.lit(0).alias("s")).limit(0)
        out = None
        for i, w in enumerate(p.words):
            hit = index.starting(w) if p.prefix and i == len(p.words) - 1 else index.of([w])
            hit = hit.select("id", F.explode("positions").alias("s")).select("id", (F.col("s") - i).alias("s"))
            out = hit if out is None else out.join(hit, ["id", "s"], "left_semi")
        return out.where("s = 0") if p.first else out

    def of(t: object) -> DataFrame:
        if isinstance(t, Phrase):
            if len(t.words) == 1 and not t.prefix and not t.first:
                return index.of(list(t.words)).select("id")  # a word has one posting a row
            return starts(t).select("id").distinct()
        if isinstance(t, Near):
            out = None
            for i, p in enumerate(t.phrases):
                s = starts(p).select("id", F.struct(F.col("s").alias("a"), (F.col("s") + len(p.words) - 1).alias("z")).alias(f"p{i}"))
                out = s if out is None else out.join(s, "id")
            if len(t.phrases) > 1:
                ends = [F.col(f"p{i}") for i in range(len(t.phrases))]
                words = sum(len(p.words) for p in t.phrases)
                span = F.greatest(*[e["z"] for e in ends]) - F.least(*[e["a"] for e in ends]) + 1
                out = out.where(span - words <= t.gap)
            return out.select("id").distinct()
        a, b = of(t.left), of(t.right)
        return a.union(b).distinct() if t.kind == "OR" else a.join(b, "id", "left_semi" if t.kind == "AND" else "left_anti")

    return of(tree)


def as_words(query: str) -> object:
    """A query that can't be read, as all of its words."""
    words = query_terms(query, drop=False)
    tree: object = Phrase((words[0],)) if words else Phrase(())
    for w in words[1:]:
        tree = Op("AND", tree, Phrase((w,)))
    return tree


def words_in(tree: object) -> list[str]:
    """The words that a parsed query scores by: those of a NOT's right side don't count."""
    if isinstance(tree, Phrase):
        return list(tree.words)
    if isinstance(tree, Near):
        return [w for p in tree.phrases for w in p.words]
    return words_in(tree.left) + ([] if tree.kind == "NOT" else words_in(tree.right))


def keyword_search(query: str, index: KeywordIndex) -> tuple[DataFrame, list[str], str]:
    """(id) of the matches, the words to score them by, and a note if the query had to be taken as all of its words."""
    try:
        tree, note = parse(query), ""
    except QuerySyntaxError as e:
        tree, note = as_words(query), f"syntax error ({e}); searched as plain terms instead: {' '.join(query_terms(query, drop=False))}"
    return matches(tree, index), words_in(tree), note
