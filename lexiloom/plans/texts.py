"""Queries of text structure: formats are written around the documents' own text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunking as C
from ..operators import formats as X
from .register import query, table


@query("select doc_id, case doc_id % 6 when 0 then 'paragraphs' when 1 then 'pages' when 2 then 'verse' when 3 then 'folio' when 4 then 'chronicle' else 'plain' end AS format from documents")
def text_format_detect(spark, sf):
    """Each format by what marks it; a chronicle by its ten headings in capitals."""
    rubrics = "".join(f"DE REBUS GESTIS {chr(65 + i) * 2} - text\n" for i in range(10))
    head = F.element_at(F.array(*[F.lit(x) for x in (X.PARAGRAPHS_FIRST_LINE + "\n", "## p. 10 (#1) ####\n", "Title\n" + X.HEADER_END + "\n[1] a\n", "[foglio I, recto] ", rubrics, "")]), (F.col("doc_id") % 6 + 1).cast("int"))
    return table(spark, sf, "documents").select("doc_id", X.detected(F.concat(head, "text")).alias("format"))


@query(r"select doc_id, len(list_filter(string_split_regex(text, '[.!?;:]\s+'), lambda s: s <> '')) AS n_sentences from documents")
def sentence_units(spark, sf):
    parts = F.filter(F.split("text", r"[.!?;:]\s+"), lambda s: s != "")
    return table(spark, sf, "documents").select("doc_id", F.size(parts).cast("long").alias("n_sentences"))


@query()
def chunk_documents(spark, sf):
    return C.chunk_documents(table(spark, sf, "documents"))


@query()
def chunk_pages(spark, sf):
    """Documents as the pages of their source: chunks restart on each page."""
    d = table(spark, sf, "documents")
    return C.chunk_documents(d).join(d.select("doc_id", "source"), "doc_id").select(F.concat(F.col("source"), F.lit(":p"), "doc_id", F.lit(":c"), F.col("seq") + 1).alias("chunk_id"), "chunk")


@query()
def chunk_overlap_check(spark, sf):
    from pyspark.sql import Window

    c = C.chunk_documents(table(spark, sf, "documents"))
    pairs = c.withColumn("before", F.lag("chunk").over(Window.partitionBy("doc_id").orderBy("seq"))).where("before is not null")
    return pairs.select("doc_id", "seq", C.overlaps("before", "chunk").alias("overlap"))


def _formatted(spark, sf, head: str, line: str):
    """Each document's lines with a prefix; %n is the line's number."""
    lines = F.transform(F.split("text", "\n"), lambda t, i: F.concat(F.regexp_replace(F.lit(line), "%n", (i + 1).cast("string")), t))
    return table(spark, sf, "documents").select("doc_id", F.concat(F.lit(head), F.array_join(lines, "\n")).alias("text"))


@query()
def page_split_filter(spark, sf):
    return X.chunk_texts(_formatted(spark, sf, "", "## p. %n (#%n) ####\n"))


@query()
def verse_chunks(spark, sf):
    return X.chunk_texts(_formatted(spark, sf, f"Title\n{X.HEADER_END}\n## Act I\nSPEAKER\n", "[%n] "))


@query()
def chronicle_sections(spark, sf):
    return X.chunk_texts(_formatted(spark, sf, "Anno Domini 1100 a\nAnno Domini 1101 b\nAnno Domini 1102 c\nAnno Domini 1103 d\nAnno Domini 1104 e\n", "Anno Domini 12%n "))


@query()
def folio_sections(spark, sf):
    return X.chunk_texts(_formatted(spark, sf, "", "[foglio %n, recto] "))


@query()
def plain_chunks(spark, sf):
    return X.chunk_texts(table(spark, sf, "documents"))


@query()
def para_chapters(spark, sf):
    return X.chunk_texts(_formatted(spark, sf, X.PARAGRAPHS_FIRST_LINE + '\n%%CHAPTER id=7 part=I label="Chapter" kind=body\n# Title\n## Section\n', "[¶%n] "))


