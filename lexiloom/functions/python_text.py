"""Functions on text that built-ins can't express: UDFs on Arrow batches, a few values at a time."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import each

# Fixed values of the HTML rules: what is dropped with all it holds, what stands apart by blank lines.
DROPPED = frozenset("script style noscript template svg nav iframe form".split())
DROPPED_BESIDES_MAIN = frozenset("header footer".split())
DROPPED_IN_AUDIT = frozenset("script style noscript nav header footer".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote br dd div dl dt figcaption figure h1 h2 h3 h4 h5 h6 hr li ol p pre section table td th tr ul".split())
# French short forms after whose full stop a sentence goes on.
FRENCH_SHORT = frozenset("""p pp cf fol fols ch chap n nn no nos t vol vols éd éds ed edd dir op cit ca s.v sv ibid id art doc docs ms mss fasc col coll
loc trad suppl sq sqq ss st ste mgr av apr env corp soppr dipl proc reg cod fig pl tav tab cap lib can sec saec not vv cfr
réf rééd mm mme mlle dr prof s.d s.l a.c j.-c ann app""".split())
#: A language's most frequent words.
STOPWORDS = {
    "en": frozenset("the of and to in is that was for it with as on are this be by from at or not".split()),
    "fr": frozenset("le la les de des du et un une est que qui dans pour sur par pas au aux elle en".split()),
    "de": frozenset("der die das und ist von den mit zu im ein eine nicht auf für sich auch dem des als".split()),
    "it": frozenset("il lo la gli le di del della che e un una in per con non si al alla dei nel sono come più anche".split()),
    "la": frozenset("et in est ad cum non ut quod qui quae ex sed ab per esse sunt de hoc enim autem atque nec ac".split()),
}


@each(T.StringType())
def fold_accents(t: str | None) -> str | None:
    """Lower case without marks, after compatibility decomposition."""
    return None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).lower()


class _Text(HTMLParser):
    def __init__(self, dropped: frozenset[str]):
        super().__init__(convert_charrefs=True)
        self.dropped, self.open, self.hidden = dropped, [], 0
        self.parts: list[str] = []
        self.regions: list[tuple[str, int, int]] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        if tag in BLOCKS:
            self.parts.append("\n\n")
        if tag in VOID:
            return
        hides = tag in self.dropped or a.get("role") == "navigation" or a.get("aria-hidden") == "true"
        self.hidden += hides
        self.open.append((tag, hides, len(self.parts)))

    def handle_endtag(self, tag: str) -> None:
        if not any(t == tag for t, *_ in self.open):
            return
        while self.open:  # an unclosed tag ends with the one around it
            t, hides, start = self.open.pop()
            self.hidden -= hides
            if t in ("main", "article", "body"):
                self.regions.append((t, start, len(self.parts)))
            if t == tag:
                break
        if tag in BLOCKS:
            self.parts.append("\n\n")

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.parts.append(re.sub(r"\s+", " ", data))


def _html(raw: str | None, main_only: bool) -> str | None:
    if raw is None:
        return None
    p = _Text((DROPPED | DROPPED_BESIDES_MAIN) if main_only else DROPPED_IN_AUDIT)
    p.feed(raw)
    p.close()
    for tag, _, start in p.open:
        if tag in ("main", "article", "body"):
            p.regions.append((tag, start, len(p.parts)))
    text = lambda r: "".join(p.parts[r[1] : r[2]])
    whole = ("", 0, len(p.parts))
    if main_only:
        mains = [r for r in p.regions if r[0] == "main"]
        articles = [r for r in p.regions if r[0] == "article"]
        bodies = [r for r in p.regions if r[0] == "body"]
        whole = mains[0] if mains else max(articles, key=lambda r: len(text(r).strip())) if articles else bodies[0] if bodies else whole
    paragraphs = (" ".join(x.split()) for x in re.split(r"\n\s*\n", text(whole)))
    return ("\n\n" if main_only else "\n").join(x for x in paragraphs if x)


def html_text(column: str | Column, main_only: bool) -> Column:
    """The page's text, a blank line between blocks; main_only: of its main part, else the longest article, else the body."""
    return each(T.StringType())(lambda h: _html(h, main_only))(column)


#: What may follow a French sentence's end: white space, then a capital, maybe in quotes or brackets.
_FRENCH_END = re.compile(r"(?P<stop>[.!?…]+)[»”\"’)\]]*(?=\s+[«“\"(\[]?\s?[A-ZÀ-ÖØ-Þ])|(?P<open>«)|(?P<close>»)")
_ROMAN = re.compile(r"[IVXLCDM]+(?:er|re|e)?")
#: French and Italian words that are spelled like Roman numerals, a fixed value.
_NOT_ROMAN = frozenset("Le De Ce Me Mi Di Ci Li Vi Mille".split())


def _goes_on(word: str) -> bool:
    """Whether a full stop after the word belongs to it: a short form, an initial, letters with stops or a hyphen, an ordinal."""
    bare = word.lower().rstrip(".")
    initials = re.fullmatch(r"[^\W\d_]|(?:\w\.)+\w|\w\.?-\w", bare)
    return bool(initials) or bare in FRENCH_SHORT or bool(_ROMAN.fullmatch(word)) and word not in _NOT_ROMAN


def sentence_ends(text: str, inside_quotes: bool = False) -> list[int]:
    """Where French sentences end, closing marks included; not after short forms, and not inside « » unless asked."""
    out, depth = [], 0
    for m in _FRENCH_END.finditer(text):
        if m["stop"]:
            # closing marks that the end takes along count before it is judged
            deep = depth - m.group().count("»")
            if (inside_quotes or deep <= 0) and not (m["stop"][0] == "." and _goes_on(re.search(r"\S*$", text[max(0, m.start() - 80) : m.start()]).group().lstrip("([«“\""))):
                out.append(m.end())
            depth = deep
        else:
            depth += 1 if m["open"] else -1
    return out


@each(T.ArrayType(T.StringType()))
def french_sentences(t: str | None) -> list[str] | None:
    if t is None:
        return None
    ends = [0, *sentence_ends(t), len(t)]
    return [s for a, b in zip(ends, ends[1:]) if (s := t[a:b].strip())]


@each(T.StringType())
def stopword_language(t: str | None) -> str:
    """The language whose frequent words make up most of the text; empty under 20 letters or without any such word."""
    if t is None or sum(map(str.isalpha, t)) < 20:
        return ""
    words = re.findall(r"[^\W\d_]+", t.lower())
    share = {lang: sum(w in stop for w in words) for lang, stop in STOPWORDS.items()}
    top = max(sorted(share), key=share.get)
    return top if share[top] else ""


def hashed_embedding(column: str | Column, dimensions: int) -> Column:
    """A deterministic stand-in for a model: hashed words, unit length; the place for a real encoder."""

    def embed(t: str | None) -> list[float]:
        v = np.zeros(dimensions)
        for w in (t or "").lower().split():
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
            v[h % dimensions] += 1 if h >> 32 & 1 else -1
        n = np.linalg.norm(v)
        return (v / n if n else v).astype(np.float32).tolist()

    return each(T.ArrayType(T.FloatType()))(embed)(column)


def shortened_label(label: str, place: str, most: int = 70) -> str:
    """`label, place` within so many characters: the label loses words at its end, but never its first, and the place nothing."""
    joint = ", " if place.startswith("¶") else ""
    fits = lambda x: len(x) + (len(joint) if x else 0) + len(place) <= most
    words = label.split(" ")
    shorter = (" ".join(words[:k]).rstrip(" ,;:") + "…" for k in range(len(words) - 1, 0, -1))
    out = label if fits(label) or len(words) == 1 else next((x for x in shorter if fits(x)), words[0].rstrip(" ,;:") + "…")
    return out + (joint if out else "") + place


def paragraphs_place(a: int, b: int) -> str:
    return (f"¶{a}" if a == b else f"¶{a}–{b}") if a else ""


@F.pandas_udf(T.StringType())
def paragraph_location(label: pd.Series, first: pd.Series, last: pd.Series) -> pd.Series:
    """`label, ¶a–b` in 70 characters."""
    return pd.Series([shortened_label(x or "", paragraphs_place(int(a), int(b))) for x, a, b in zip(label, first, last)])
