"""Records, files and pages: how sources are put together, which file a record means, what its pages are called and hold."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X

# Phrases of cover sheets, and kinds of records whose page field says where printed pages begin.
COVER_PHRASES = (
    "stable url", "author(s):", "published by", "for additional information about this article", "access provided", "your use of the jstor archive", "request date", "ill number", "ill #",
    "patron:", "lender string", "borrower:", "call number", "call#", "supplied by", "tn:", "reproduced with permission of copyright owner", "copyright and use", "core metadata",
    "follow this and additional works", "recommended citation", "interlibrary", "odyssey:", "this material may be protected by copyright",
)
#: Visible characters of a page with a text layer; dark share of a blank page; words that recognition finds on a plate at most.
PAGE_CHARS, DARK, PLATE_WORDS = 50, 0.002, 20


def route(mime: Column, name: Column) -> Column:
    """How an attachment is read: ignored (XML), text, pdf or html, by its type and, without one, its name."""
    m, n = F.lower(F.coalesce(mime, F.lit(""))), F.lower(F.coalesce(name, F.lit("")))
    xml = m.isin("text/xml", "application/xml") | n.endswith(".xml")
    plain = (m == "text/plain") | ((m == "") & n.endswith(".txt"))
    return F.when(xml, "ignored").when(plain, "text").when((m == "application/pdf") | ((m == "") & n.endswith(".pdf")), "pdf").when(m.isin("text/html", "application/xhtml+xml"), "html").otherwise("none")


def missing_keys(wanted: DataFrame, there: DataFrame, key: str) -> DataFrame:
    """(key) of the wanted ones that aren't there."""
    return wanted.select(key).distinct().join(there.select(key), key, "left_anti")


def assembled(items: DataFrame, children: DataFrame, annotations: DataFrame, embedded: DataFrame, only: DataFrame | None = None, key: str = "item_key") -> dict[str, DataFrame]:
    """The tables of one state of the library: items (of `only`, if given), their attachments and notes, annotations and embedded ones in scope.

    A wanted key that no item has is an error that names up to twenty of them. Items that several collections list count once.
    """
    items = items.dropDuplicates([key])
    if only is not None:
        if absent := [r[0] for r in missing_keys(only, items, key).orderBy(key).limit(20).collect()]:
            raise ValueError(f"not in the collection: {', '.join(map(str, absent))}")
        items = items.join(only.select(key).distinct(), key, "left_semi")
    children = children.join(items.select(key), key, "left_semi")
    attachments = children.where("kind = 'attachment'")
    scope = attachments.select("attachment_key").distinct()
    return {"items": items, "attachments": attachments, "notes": children.where("kind = 'note'"), "annotations": annotations.join(scope, "attachment_key", "left_semi"), "embedded": embedded.join(scope, "attachment_key", "left_semi")}


def chosen_files(entries: DataFrame, files: DataFrame) -> DataFrame:
    """entries (attachment_key, path) with the file to read: the recorded one, else the folder's only PDF, else null.

    files: (path) of what is there. A renamed file is found through its folder.
    """
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    pdfs = files.where(F.lower("path").endswith(".pdf")).groupBy(folder.alias("_folder")).agg(F.count(F.lit(1)).alias("_n"), F.min("path").alias("_only"))
    there = files.select(F.col("path").alias("_there")).distinct()
    e = entries.withColumn("_folder", folder).join(there, F.col("path") == F.col("_there"), "left").join(pdfs, "_folder", "left")
    return e.select(*entries.columns, F.coalesce("_there", F.when(F.col("_n") == 1, F.col("_only"))).alias("file"))


def cover_score(text: Column, width: Column, height: Column, usual_width: Column, usual_height: Column) -> Column:
    """How much a page looks like a cover sheet: two a phrase, two for an unusual size, one for little text."""
    low = F.lower(text)
    phrases = sum((F.when(low.contains(p), 2).otherwise(0) for p in COVER_PHRASES), F.lit(0))
    odd = (F.abs(width - usual_width) / usual_width > 0.02) | (F.abs(height - usual_height) / usual_height > 0.02)
    return phrases + F.when(odd, 2).otherwise(0) + F.when(X.nonws_len(text) < 150, 1).otherwise(0)


def printed_labels(labels: Column, n: Column, paged_kind: Column, field: Column, first_score: Column, last_score: Column) -> tuple[Column, Column]:
    """(a label a page, how it was found): the file's own labels unless they just count from 1; else the record's page field.

    The field counts if its range has as many pages as the file, or one less and one end looks like a cover sheet more than the other.
    """
    counting = F.transform(F.sequence(F.lit(1), n), lambda i: i.cast("string"))
    a, b = X.page_range(field)
    span = b - a + 1
    none = F.transform(F.sequence(F.lit(1), n), lambda _: F.lit(""))
    numbers = lambda k: F.transform(F.sequence(F.lit(0), k - 1), lambda i: (a + i).cast("string"))
    front = (n == span + 1) & (n >= 3) & (first_score >= 2) & (first_score > last_score)
    back = (n == span + 1) & (n >= 3) & (last_score >= 2) & (last_score > first_score)
    usable = paged_kind & a.isNotNull()
    own = labels.isNotNull() & (F.size(labels) > 0)
    trivial = F.when(own, "trivial pdf labels 1..n ignored; ").otherwise("")
    named = F.concat(F.lit("pages field "), field)
    pages = F.when(own & (labels != counting), labels).when(~usable | usable.isNull(), none).when(n == span, numbers(n)).when(front, F.concat(F.array(F.lit("")), numbers(n - 1))).when(back, F.concat(numbers(n - 1), F.array(F.lit("")))).otherwise(none)
    how = (
        F.when(~usable | usable.isNull(), "none").when(n == span, F.concat(named, F.lit(" (exact match)"))).when(front, F.concat(named, F.lit(" (cover first)"))).when(back, F.concat(named, F.lit(" (cover last)")))
        .when((n == span + 1) & (n >= 3), F.concat(named, F.lit(": extra page, cover end unclear"))).otherwise(F.concat(named, F.lit(": "), span.cast("string"), F.lit(" pages vs PDF "), n.cast("string")))
    )
    return pages, F.when(own & (labels != counting), "pdf page labels").otherwise(F.concat(trivial, how))


def derivation_key(how: Column) -> Column:
    """A derivation without its numbers, so that like ones count together."""
    return F.regexp_replace(how, r"\d+", "N")


def page_classes(pages: DataFrame, key: str) -> DataFrame:
    """pages (key, page, text, dark, words) with class: text, short, blank, plate, needs OCR, unchecked.

    One page that needs recognition settles its file: pages without text after it aren't checked.
    """
    n = X.nonws_len(F.coalesce("text", F.lit("")))
    own = F.when(n >= PAGE_CHARS, "text").when(n > 0, "short").when(F.col("dark") < DARK, "blank").when(F.col("words") < PLATE_WORDS, "plate").otherwise("needs OCR")
    w = Window.partitionBy(key).orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.coalesce(F.max((F.col("_class") == "needs OCR").cast("int")).over(w), F.lit(0)) == 1
    return pages.withColumn("_class", own).withColumn("class", F.when(earlier & ~F.col("_class").isin("text", "short"), "unchecked").otherwise(F.col("_class"))).drop("_class")


def text_layers(pages: DataFrame, key: str) -> DataFrame:
    """(key, layer): whether all, none or some of a file's sampled pages have a text layer."""
    has = X.nonws_len(F.coalesce("text", F.lit(""))) >= PAGE_CHARS
    return pages.groupBy(key).agg(F.every(has).alias("all"), F.some(has).alias("some")).select(key, F.when(F.col("all"), "text").when(F.col("some"), "mixed").otherwise("none (needs OCR)").alias("layer"))


def language_shares(parts: DataFrame, key: str, least: float = 0.02) -> DataFrame:
    """parts (key, lang, chars, confidence) -> (key, lang, share, confidence): by length; languages under the least share go, but never the first one."""
    by = parts.groupBy(key, "lang").agg(F.sum("chars").alias("n"), F.sum(F.col("confidence") * F.col("chars")).alias("c"))
    whole = Window.partitionBy(key)
    shares = by.withColumn("share", F.col("n") / F.sum("n").over(whole)).withColumn("confidence", F.sum("c").over(whole) / F.sum("n").over(whole))
    first = F.row_number().over(whole.orderBy(F.desc("n"), "lang")) == 1
    return shares.withColumn("_first", first).where(F.col("_first") | (F.col("share") >= least)).select(key, "lang", "share", "confidence")


def coverage(chunks: DataFrame, expected: DataFrame, key: str, flag: float = 1.0) -> DataFrame:
    """(key, got, expected, diff_pct, flagged): visible characters in chunks, without what their overlaps repeat, against those expected.

    chunks: (key, chunk, repeated); expected: (key, expected). Sources without chunks count as 0.
    """
    got = chunks.groupBy(key).agg(F.sum(X.nonws_len(F.col("chunk")) - F.col("repeated")).alias("got"))
    both = expected.join(got, key, "left").withColumn("got", F.coalesce("got", F.lit(0).cast("long")))
    diff = F.when(F.col("expected") > 0, 100 * (F.col("got") - F.col("expected")) / F.col("expected")).otherwise(0.0)
    return both.withColumn("diff_pct", diff).select(key, "got", "expected", "diff_pct", (F.abs("diff_pct") > flag).alias("flagged"))


def metadata_cards(items: DataFrame) -> DataFrame:
    """(source_id, source_type, seq, chunk) of each item's record, leaving out what is empty. items: item_key and text columns title, authors, ..."""
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    line = lambda name, c: F.when(has(c), F.concat(F.lit(f"{name}: "), X.squeeze(F.col(c)))) if c in items.columns else F.lit(None).cast("string")
    always = lambda name, c: F.concat(F.lit(f"{name}: "), F.coalesce(F.col(c), F.lit(""))) if c in items.columns else F.lit(f"{name}: ")
    card = F.concat_ws("\n", always("Title", "title"), line("Authors", "authors"), line("Editors", "editors"), line("Year", "yr"), always("Item type", "item_type"), line("Publication", "publication"), line("Abstract", "abstract"), line("Tags", "tags"))
    return items.select(F.concat(F.lit("meta:"), F.col("item_key").cast("string")).alias("source_id"), F.lit("metadata").alias("source_type"), F.lit(1).alias("seq"), card.alias("chunk"))


def annotation_chunks(annotations: DataFrame) -> DataFrame:
    """One chunk an annotation with text, comment or tags; ink and images have none. (ann_key, kind, body, remark, tags, printed, page)."""
    body, remark, tags = (F.trim(F.coalesce(c, F.lit(""))) for c in ("body", "remark", "tags"))
    kind = F.when(F.col("kind").isin("highlight", "underline"), "highlight").otherwise("note")
    where = F.when(F.col("printed") != "", F.concat(F.lit("p. "), F.col("printed"))).when(F.col("page") > 0, F.concat(F.lit("PDF p. "), F.col("page").cast("string"))).otherwise("")
    rows = annotations.where(~F.col("kind").isin("ink", "image")).where((body != "") | (remark != "") | (tags != ""))
    return rows.select(F.concat(F.lit("ann:"), F.col("ann_key")).alias("source_id"), kind.alias("source_type"), F.lit(1).alias("seq"), X.annotation_text(body, remark, tags, where).alias("chunk"))


def embedded_chunks(rows: DataFrame) -> DataFrame:
    """One chunk a different embedded annotation of a page: (attachment_key, page, body, remark)."""
    text = X.annotation_text(F.trim(F.coalesce("body", F.lit(""))), F.trim(F.coalesce("remark", F.lit(""))), F.lit(""), F.lit(""))
    once = rows.dropDuplicates(["attachment_key", "page", "body", "remark"]).withColumn("chunk", text).where("chunk != ''")
    mark = F.substring(X.fingerprint(F.col("page"), F.col("body"), F.col("remark")), 1, 10)
    return once.select(F.concat_ws(":", F.lit("embedded"), "attachment_key", mark).alias("source_id"), F.lit("embedded").alias("source_type"), F.lit(1).alias("seq"), "chunk")


def least_squares(points: DataFrame, keys: Sequence[str], x: str, y: str, within: float) -> DataFrame:
    """(keys, slope, intercept) of y over x: a line through the points whose y is near the group's median; level at it for under three of them."""
    middle = points.groupBy(*keys).agg(F.median(y).alias("_middle"))
    near = points.join(middle, list(keys)).where(F.abs(F.col(y) - F.col("_middle")) <= within)
    fit = near.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.regr_slope(y, x).alias("s"), F.regr_intercept(y, x).alias("i"), F.median(y).alias("m"))
    enough = (F.col("n") >= 3) & F.col("s").isNotNull()
    return fit.select(*keys, F.when(enough, F.col("s")).otherwise(0.0).alias("slope"), F.when(enough, F.col("i")).otherwise(F.col("m")).alias("intercept"))


def last_error_line(lines: Column) -> Column:
    """The line of a log that says most about why it ended; an exit code goes behind the line before it."""
    told = F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("Done:"))
    bad = F.filter(told, lambda x: x.rlike("(?i)error|failed|exception|traceback|not found|skipping"))
    code = F.regexp_extract(F.try_element_at(bad, F.lit(-1)), r"ocrmypdf failed with exit code (\d+)", 1)
    last = F.when((F.size(bad) > 1) & (code != ""), F.concat(F.try_element_at(bad, F.lit(-2)), F.lit(" (ocrmypdf exit code "), code, F.lit(")"))).otherwise(F.try_element_at(bad, F.lit(-1)))
    return F.coalesce(F.when(F.size(bad) > 0, last), F.try_element_at(told, F.lit(-1)), F.lit("no output"))


@F.pandas_udf(T.DoubleType())
def dark_share(pixels: pd.Series) -> pd.Series:
    """Share of an 8-bit grey image's pixels that are darker than the middle; null for null, 0 for none."""
    return pixels.map(lambda p: None if p is None else sum(b < 128 for b in p) / max(1, len(p)))


def text_lines(words: DataFrame, keys: Sequence[str], least_confidence: float = -1.0) -> DataFrame:
    """Lines of recognised words (keys, level, block, par, line, left, top, width, height, conf, text), in order of top and left.

    Only words (level 5) that aren't blank; below least_confidence none.
    """
    w = words.where((F.col("level") == 5) & (F.trim(F.coalesce("text", F.lit(""))) != "") & (F.col("conf") >= least_confidence))
    inner = F.array_sort(F.collect_list(F.struct("left", "width", "text")))
    by = w.groupBy(*keys, "block", "par", "line").agg(F.min("top").alias("top"), F.min("left").alias("left"), F.max(F.col("left") + F.col("width")).alias("right"), F.max(F.col("top") + F.col("height")).alias("bottom"), inner.alias("_w"))
    return by.withColumn("text", F.array_join(F.transform("_w", lambda x: x["text"]), " ")).drop("_w")
