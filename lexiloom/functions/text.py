"""Scalar functions on text, names, dates and pages, as column expressions that stay inside the JVM."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters that are a Latin letter with marks, and that letter; the table follows from Unicode's decompositions.
_MARKED = {c: d[0] for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]) if (d := unicodedata.normalize("NFD", c))[0].isascii() and len(d) > 1}


def folded(c: str | Column) -> Column:
    """Lower case, Latin letters without their marks, whether written as one character or two: stays inside the JVM."""
    low = F.regexp_replace(F.lower(c), r"[\u0300-\u036f]+", "")
    return F.translate(low, "".join(_MARKED), "".join(_MARKED.values()))


def fold_text(text: str) -> str:
    """folded() of one text."""
    return re.sub(r"[\u0300-\u036f]+", "", text.lower()).translate(str.maketrans(_MARKED))


def squeeze(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def clean_text(c: Column) -> Column:
    """Without control characters; words broken at a line end joined; white space squeezed within paragraphs, which blank lines part."""
    c = F.regexp_replace(c, r"[\x00-\x08\x0B-\x1F\x7F]", "")
    c = F.regexp_replace(c, "\u00a0", " ")
    c = F.regexp_replace(c, r"(\p{L})[-\x{AC}\x{AD}]\n\s*(\p{Ll})", "$1$2")
    parts = F.transform(F.split(c, r"\n[ \t]*\n"), squeeze)
    return F.array_join(F.filter(parts, lambda p: p != ""), "\n\n")


def clean_text_inline(c: Column) -> Column:
    """One line: every hyphenated line end joined whatever the case, every not-sign dropped."""
    c = F.regexp_replace(c, r"(\p{L})[-\x{AC}\x{AD}]\s*\n\s*(\p{L})", "$1$2")
    return squeeze(F.regexp_replace(c, "\u00ac", ""))


def joined_lines(lines: Column) -> Column:
    """Lines of a column as one text: a word that a hyphen or not-sign breaks at a line's end goes on if the next line begins with a small letter."""
    return squeeze(F.regexp_replace(F.array_join(lines, "\n"), r"(\p{L})[-\x{AC}]\n(\p{Ll})", "$1$2"))


def nonws_len(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"\s", "")).cast("long")


def letter_count(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"[^\p{L}]", "")).cast("long")


def enough_text(c: Column, least: int = 25) -> Column:
    return nonws_len(c) >= least


def norm_ann(c: Column) -> Column:
    """Lower case, only letters, digits and underscores: the key under which two annotations count as one."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]+", "")


def word_list(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def short_title(short: Column, title: Column) -> Column:
    """The short title if all its words are in the title, else the title up to its first colon or full stop before a space."""
    ours = F.size(F.array_except(word_list(short), word_list(title))) == 0
    return F.when((short != "") & ours, short).otherwise(F.trim(F.regexp_extract(title, r"^(.*?)(?:[:.]\s.*)?$", 1)))


def year_of(parsed: Column, date: Column) -> Column:
    """The first four characters of the parsed date, else the date's first number of four digits, else empty."""
    return F.when(F.coalesce(parsed, F.lit("")) != "", F.substring(parsed, 1, 4)).otherwise(F.regexp_extract(F.coalesce(date, F.lit("")), r"(?:^|[^0-9A-Za-z_])([0-9]{4})(?:[^0-9A-Za-z_]|$)", 1))


def title_of(title: Column, note: Column) -> Column:
    """The title; for notes the first non-blank line of their text, 120 characters at most."""
    line = F.regexp_extract(F.coalesce(note, F.lit("")), r"^\s*([^\n]*)", 1)
    first = F.substring(F.trim(line), 1, 120)
    return F.when(F.coalesce(title, F.lit("")) != "", title).when(first != "", first).otherwise("(empty note)")


def page_range(pages: Column) -> tuple[Column, Column]:
    """First and last page of a field with exactly one range, its end maybe abbreviated (141-53); nulls unless the end isn't before the start."""
    range_ = r"([0-9]+)\s*[-\u2013\u2014]\s*([0-9]+)"
    field = F.coalesce(pages, F.lit(""))
    one = F.regexp_count(field, F.lit(range_)) == 1
    a, b = (F.when(one, F.regexp_extract(field, range_, k)) for k in (1, 2))
    short = (F.length(b) < F.length(a)) & (b.try_cast("long") < a.try_cast("long"))
    full = F.when(short, F.concat(F.substring(a, F.lit(1), F.length(a) - F.length(b)), b)).otherwise(b)
    first, last = a.try_cast("int"), full.try_cast("int")
    ok = last >= first
    return F.when(ok, first), F.when(ok, last)


def decode_hex_label(label: Column) -> Column:
    """A label as <FEFF...> is UTF-16 in hexadecimal; any other stays."""
    digits = F.regexp_extract(label, r"^<(?:FEFF|feff)((?:[0-9A-Fa-f]{4})+)>$", 1)
    return F.when(digits != "", F.decode(F.unhex(digits), "UTF-16BE")).otherwise(label)


def pdf_date_iso(raw: Column) -> Column:
    """D:YYYYMMDDHHMMSS as ISO text, as far as it is given; anything else stays."""
    whole = r"^D?:?([0-9]{4})([0-9]{2})([0-9]{2})(?:([0-9]{2})([0-9]{2})([0-9]{2}))?.*$"
    day = F.regexp_replace(raw, whole, "$1-$2-$3")
    time = F.regexp_replace(raw, whole, "$1-$2-$3T$4:$5:$6")
    return F.when(raw.rlike(r"^D?:?[0-9]{14}"), time).when(raw.rlike(r"^D?:?[0-9]{8}"), day).otherwise(raw)


def page_of(source_type: Column, location: Column, printed: Column, page: Column) -> Column:
    """What a citation says of the place: a text file's location or printed page; else the printed page or the file's page.

    Snapshots, bibliographic records and chunks without a page say nothing; a printed page may bring its own `p.`.
    """
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    p = lambda c: F.when(c != "", F.concat(F.lit("p. "), c))
    of_file = F.when(text(location) != "", location).otherwise(F.coalesce(p(text(printed)), F.lit("")))
    own = F.regexp_replace(text(printed), r"^p+\.\s*", "")
    paged = F.coalesce(p(own), F.concat(F.lit("PDF p. "), page.cast("string")))
    nowhere = source_type.isin("snapshot", "metadata") | (F.coalesce(page, F.lit(0)) == 0)
    return F.when(source_type == "text_file", of_file).when(nowhere, "").otherwise(paged)


def voice(source_type: Column, text: Column) -> Column:
    """Whose words a chunk holds, by its kind and, for the reader's marks, by how its text begins."""
    fixed = F.create_map(*[F.lit(x) for x in (
        "pdf_text", "author", "snapshot", "author", "text_file", "edition", "metadata", "record", "child_note", "my note",
    )])
    quoted = F.when(text.contains("My comment:"), "my highlight with comment").otherwise("my highlight")
    return F.coalesce(fixed[source_type], F.when(text.startswith("Highlighted:"), quoted).otherwise("my comment"))


def strip_header(c: Column) -> Column:
    """Without a first line that opens with [ and ends in ], if there is more; only its own line break goes."""
    return F.regexp_replace(c, r"^\[[^\n]*\]\n(?=[\s\S])", "")


def split_tags(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ";"), lambda t: F.lower(F.trim(t))), lambda t: t != "")


def annotation_text(text: Column, comment: Column, tags: Column, where: Column | None = None) -> Column:
    """An annotation as a chunk's text: what is highlighted, the reader's comment, the tags, each on its own line if any.

    One with nothing but tags says so, and where it stands.
    """
    place = F.lit("") if where is None else F.when(where != "", F.concat(F.lit(" on "), where)).otherwise("")
    alone = (text == "") & (comment == "") & (tags != "")
    lines = F.concat_ws("\n", F.when(text != "", F.concat(F.lit("Highlighted: "), text)), F.when(comment != "", F.concat(F.lit("My comment: "), comment)), F.when(tags != "", F.concat(F.lit("Tags: "), tags)))
    return F.when(alone, F.concat(F.lit("Tagged note"), place, F.lit(": "), tags)).otherwise(lines)


def page_from_position(json: Column) -> Column:
    """One-based page of an annotation's position; 0 if the JSON is broken or has none."""
    return F.coalesce(F.try_variant_get(F.try_parse_json(json), "$.pageIndex", "int") + 1, F.lit(0))


def fingerprint(*parts: Column) -> Column:
    """16 hexadecimal digits of a SHA-1 over all parts, nulls included."""
    return F.substring(F.sha1(F.to_json(F.struct(*[p.cast("string").alias(f"p{i}") for i, p in enumerate(parts)]), {"ignoreNullFields": "false"})), 1, 16)


def md_plain(c: Column) -> Column:
    """Without note calls and asterisks that nothing escapes; escaped asterisks, underscores and backslashes as themselves."""
    c = F.regexp_replace(c, r"\[\^[\p{L}\p{N}_-]+\]", "")
    c = F.regexp_replace(c, r"(?<!\\)\*", "")
    return squeeze(F.regexp_replace(c, r"\\([\\*_])", "$1"))


def ellipsis(c: Column, most: int) -> Column:
    return F.when(F.length(c) > most, F.concat(F.rtrim(F.substring(c, 1, most - 1)), F.lit("…"))).otherwise(c)


def first_words(c: Column, n: int) -> Column:
    words = F.split(squeeze(c), " ")
    return F.when(F.size(words) > n, F.concat(F.array_join(F.slice(words, 1, n), " "), F.lit("…"))).otherwise(F.array_join(words, " "))


def rubric_location(year: Column, rubric: Column, most: int = 70) -> Column:
    """`a. YEAR, Rubric`: sentence case, without a closing full stop, cut with an ellipsis."""
    r = F.trim(F.regexp_replace(F.trim(rubric), r"\.+$", ""))
    r = F.when(F.coalesce(r, F.lit("")) != "", F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, 2, 10_000))))
    return ellipsis(F.concat_ws(", ", F.when(year > 0, F.concat(F.lit("a. "), year.cast("string"))), r), most)


def header_line(surname: Column, year: Column, title: Column, place: Column) -> Column:
    """`[Surname Year · title's first eight words · place]`, leaving out what is empty."""
    who = F.concat_ws(" ", F.when(surname != "", surname), F.when(year != "", year))
    return F.concat(F.lit("["), F.concat_ws(" · ", F.when(who != "", who), F.when(title != "", first_words(title, 8)), F.when(place != "", place)), F.lit("]"))


def citation(surname: Column, year: Column, title: Column, place: Column) -> Column:
    who = F.concat_ws(" ", F.when(surname != "", surname), F.when(year != "", year))
    who = F.when(who == "", F.lit("[no author]")).otherwise(who)
    return F.concat_ws(", ", who, F.when(title != "", first_words(title, 10)), F.when(place != "", place))


def sample_indices(n: Column, k: int) -> Column:
    """k page indexes spread over n pages, at (i + 1/2) / k of them, without repeats."""
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor((i + 0.5) / k * n).cast("int")))
