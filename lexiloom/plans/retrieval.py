"""Queries of the index and of retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import retrieval as R
from ..operators.index import KeywordIndex, postings, shared_root, term_list
from ..operators.serve import Library, attachment_rollup, browsed
from .register import CHUNKS, chunks, query, table

_TERMS = ("the", "tion", "scum")
_WORDS = r"list_filter(string_split_regex(lower(strip_accents(text)), '[^\p{L}\p{N}]+'), lambda w: w <> '')"


def _bm25(terms=_TERMS, table_="documents", id_="doc_id", k=50) -> str:
    tf = ", ".join(f"cast(len(list_filter(w, lambda x: x = '{t}')) as double) tf{i}" for i, t in enumerate(terms))
    df = ", ".join(f"cast(count(*) filter (where tf{i} > 0) as double) df{i}" for i in range(len(terms)))
    one = " + ".join(f"case when tf{i} > 0 then (case when ln((n - df{i} + 0.5) / (df{i} + 0.5)) <= 0 then 1e-6 else ln((n - df{i} + 0.5) / (df{i} + 0.5)) end) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * len / mean)) else 0.0 end" for i in range(len(terms)))
    some = " or ".join(f"tf{i} > 0" for i in range(len(terms)))
    return f"(with w as (select {id_} id, {_WORDS} w from {table_}), c as (select id, cast(len(w) as double) len, {tf} from w), s as (select cast(count(*) as double) n, avg(len) mean, {df} from c) select id, {one} score from c, s where {some} order by score desc, id limit {k})"


_KNN = "(select vec_id id, list_dot_product(cast(embedding as double[]), (select cast(embedding as double[]) from embeddings where vec_id = 0)) score from embeddings order by score desc, id limit 50)"


@query(f"select row_number() over (order by score desc, id) AS rank, id AS doc_id, round(score, 6) AS score from {_bm25()}")
def bm25_search(spark, sf):
    return R.ranked(_index(spark, sf).bm25(_TERMS)).select(F.col("rank").cast("long"), F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


@query(f"select count(*) AS n, round(avg(len(w)), 6) AS mean_length, count(*) filter (where list_contains(w, 'the')) AS df_the, count(*) filter (where list_contains(w, 'scum')) AS df_scum from (select {_WORDS} w from documents)")
def bm25_stats(spark, sf):
    w = table(spark, sf, "documents").select(term_list("text").alias("w"))
    return w.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.size("w")), 6).alias("mean_length"), F.count_if(F.array_contains("w", "the")).alias("df_the"), F.count_if(F.array_contains("w", "scum")).alias("df_scum"))


def _query_vector(spark, sf):
    return table(spark, sf, "embeddings").where("vec_id = 0").select(F.col("embedding").alias("q"))


@query(f"select row_number() over (order by score desc, id) AS rank, id AS vec_id, round(score, 6) AS score from {_KNN}")
def topk_semantic(spark, sf):
    return R.ranked(R.nearest(table(spark, sf, "embeddings"), _query_vector(spark, sf))).select(F.col("rank").cast("long"), F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


@query(f"with a as (select id, row_number() over (order by score desc, id) r from {_KNN}), b as (select id, row_number() over (order by score desc, id) r from {_bm25()}) select coalesce(a.id, b.id) AS id, round(coalesce(1.0 / (60 + a.r), 0) + coalesce(1.0 / (60 + b.r), 0), 10) AS rrf, coalesce(a.r, 0) AS semantic_rank, coalesce(b.r, 0) AS keyword_rank from a full join b on a.id = b.id order by coalesce(1.0 / (60 + a.r), 0) + coalesce(1.0 / (60 + b.r), 0) desc, a.r nulls last, b.r nulls last limit 20")
def hybrid_rrf(spark, sf):
    f = R.fused(R.nearest(table(spark, sf, "embeddings"), _query_vector(spark, sf)), _index(spark, sf).bm25(_TERMS), 20)
    return f.select("id", F.round("rrf", 10).alias("rrf"), *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("semantic_rank", "keyword_rank")])


@query(f"with a as (select id, row_number() over (order by score desc, id) r from {_KNN}), b as (select id, row_number() over (order by score desc, id) r from {_bm25()}) select 'semantic' AS retriever, id, r AS rank from a union all select 'keyword', id, r from b")
def rank_per_retriever(spark, sf):
    both = {"semantic": R.nearest(table(spark, sf, "embeddings"), _query_vector(spark, sf)), "keyword": _index(spark, sf).bm25(_TERMS)}
    a, b = (R.ranked(hits).select(F.lit(name).alias("retriever"), "id", F.col("rank").cast("long").alias("rank")) for name, hits in both.items())
    return a.unionByName(b)


@query(f"select term, id AS doc_id, count(*) AS tf, min(p) - 1 AS first_position from (select doc_id id, unnest(w) term, generate_subscripts(w, 1) p from (select doc_id, {_WORDS} w from documents)) group by all")
def build_postings(spark, sf):
    p = postings(table(spark, sf, "documents"))
    return p.select("term", F.col("id").alias("doc_id"), "tf", F.col("positions")[0].cast("long").alias("first_position"))


@query(f"select item_id, array_to_string(list_sort(list_distinct(case when len(kept) > 0 then kept else w end)), ' ') AS terms from (select item_id, w, list_filter(w, lambda x: len(x) > 1 and not list_contains([{', '.join(repr(t) for t in sorted(R.STOPWORDS))}], x)) kept from (select item_id, list_filter(string_split_regex(lower(strip_accents(text)), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') w from benchmark))")
def query_terms(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.array_join(F.array_sort(R.term_lists("text")), " ").alias("terms"))


#: Indexes built in this session, by table folder and application.
_built: dict[tuple[str, str], KeywordIndex] = {}


def _index(spark, sf):
    """The stored index of the documents: built once, then only read."""
    key = sf, spark.sparkContext.applicationId
    if key not in _built:
        _built[key] = KeywordIndex.build(table(spark, sf, "documents"), shared_root(spark, "index"))
    return _built[key]


def _search(spark, sf, q):
    return R.keyword_search(q, _index(spark, sf))[0].select(F.col("id").alias("doc_id"))


_PADDED = r"concat(' ', array_to_string(list_filter(string_split_regex(lower(strip_accents(text)), '[^\p{L}\p{N}]+'), lambda w: w <> ''), ' '), ' ')"


@query(f"select doc_id from documents where contains({_PADDED}, ' of the ')")
def fts_phrase(spark, sf):
    return _search(spark, sf, '"of the"')


@query(f"select doc_id from documents where regexp_matches({_PADDED}, ' scum ([^ ]+ ){{0,30}}the ') or regexp_matches({_PADDED}, ' the ([^ ]+ ){{0,30}}scum ')")
def fts_near(spark, sf):
    return _search(spark, sf, "NEAR(scum the, 30)")


@query(f"select doc_id from documents where contains({_PADDED}, ' thinga')")
def fts_prefix(spark, sf):
    return _search(spark, sf, "thinga*")


@query(f"select doc_id from documents where (contains({_PADDED}, ' the ') and contains({_PADDED}, ' trash ') and not contains({_PADDED}, ' idiot ')) or contains({_PADDED}, ' scum ')")
def fts_boolean(spark, sf):
    return _search(spark, sf, "the trash NOT idiot OR scum")


@query(f"select a.chunk_id, b.pdf_page AS page, count(*) AS n, string_agg(b.chunk_id, ',' order by b.doc_id) AS parts from (select * from ({CHUNKS}) where doc_id % 50 = 0) a join ({CHUNKS}) b on a.attachment_key = b.attachment_key and b.source_type = 'pdf_text' and b.pdf_page between a.pdf_page - 2 and a.pdf_page + 3 group by all")
def context_pages(spark, sf):
    """Pages around each query chunk (ids divisible by 50), against all chunks."""
    c = chunks(spark, sf)
    hits = c.where("doc_id % 50 = 0").select("attachment_key", "pdf_page", "chunk_id")
    near = R.band_join(hits, c.where("source_type = 'pdf_text'"), ["attachment_key"], "pdf_page", 2, 3, {"pdf_page": "page", "chunk_id": "part", "doc_id": "no"})
    named = F.transform(F.array_sort(F.collect_list(F.struct("no", "part"))), lambda x: x["part"])
    return near.groupBy("chunk_id", "page").agg(F.count(F.lit(1)).alias("n"), F.array_join(named, ",").alias("parts"))


@query(r"with h as (select doc_id, text, substr(text, 1, cast(length(text) // 2 + 150 as int)) a, substr(text, cast(length(text) // 2 + 1 as int)) b from documents), k as (select *, case when length(text) >= 400 then list_max(list_filter(range(16, least(2000, length(a), length(b)) + 1), lambda x: right(a, x) = left(b, x))) end k from h) select doc_id, case when length(text) < 400 then text else concat(a, substr(b, cast(k + 1 as int))) end AS stitched from k")
def stitch_chunks(spark, sf):
    """Each text in two halves that overlap by up to 150 characters, put together again. Texts too short to overlap are one part."""
    half = F.floor(F.length("text") / 2).cast("int")
    first, second = F.substring("text", F.lit(1), half + 150), F.substring("text", half + 1, F.length("text"))
    parts = F.when(F.length("text") >= 400, F.array(first, second)).otherwise(F.array("text"))
    return table(spark, sf, "documents").select("doc_id", R.stitched_all(parts).alias("stitched"))


_LIBRARY = f"select *, case when source_type in ('highlight', 'note', 'embedded') then concat('Highlighted: ', left(text, 40), case when doc_id % 3 = 0 then chr(10) || 'My comment: yes' else '' end) else text end body, case when doc_id % 4 = 0 then 'Method; T1' else '' end marks from ({CHUNKS})"


def _library(spark, sf):
    """Chunks with annotations' texts and tags, and items by their source."""
    mark = F.when(F.col("source_type").isin("highlight", "note", "embedded"), F.concat(F.lit("Highlighted: "), F.left("text", F.lit(40)), F.when(F.col("doc_id") % 3 == 0, "\nMy comment: yes").otherwise(""))).otherwise(F.col("text"))
    c = chunks(spark, sf).withColumn("text", mark).withColumn("annotation_tags", F.when(F.col("doc_id") % 4 == 0, "Method; T1").otherwise("")).withColumn("ocr", F.col("doc_id") % 9 == 0).withColumn("has_ink_on_page", F.col("doc_id") % 6 == 0)
    i = c.select("item_key").distinct().select("item_key", F.concat(F.lit("Author of "), "item_key").alias("authors"), F.concat(F.lit("Title: "), "item_key").alias("title"), F.lit("1900").alias("yr"))
    return Library(c, i, _index(spark, sf))


@query(f"select chunk_id, case when source_type = 'child_note' or contains(body, 'My comment:') then true else false end AS commented, count(*) over () AS total from ({_LIBRARY}) where source_type in ('highlight', 'note', 'child_note') and list_contains(list_transform(string_split(marks, ';'), lambda t: lower(trim(t))), 'method') and not (source_type = 'child_note' or contains(body, 'My comment:'))")
def browse_annotations(spark, sf):
    """Annotations of three kinds with a tag and without a comment."""
    found = browsed(_library(spark, sf).rows, ("highlight", "note", "child_note"), None, ["METHOD"], False)
    commented = F.col("text").contains("My comment:") | (F.col("source_type") == "child_note")
    return found.select("chunk_id", commented.alias("commented")).join(F.broadcast(found.agg(F.count(F.lit(1)).alias("total"))))


@query(f"select attachment_key, cast(count(*) as bigint) AS chunks, bool_or(source_type = 'pdf_text' and doc_id % 9 = 0) AS ocr, count(distinct case when source_type = 'pdf_text' then pdf_page end) AS pages, coalesce(string_agg(distinct case when source_type = 'pdf_text' and doc_id % 6 = 0 then lpad(cast(pdf_page as varchar), 3, '0') end, ',' order by case when source_type = 'pdf_text' and doc_id % 6 = 0 then lpad(cast(pdf_page as varchar), 3, '0') end), '') AS ink from ({CHUNKS}) group by 1")
def item_attachments(spark, sf):
    """What an item record says of each attachment."""
    r = attachment_rollup(_library(spark, sf).rows)
    total = F.aggregate(F.map_values("indexed_chunks"), F.lit(0).cast("long"), lambda a, b: a + b)
    return r.select("attachment_key", total.alias("chunks"), "ocr", F.col("pdf_pages_with_text").cast("long").alias("pages"), F.array_join(F.transform("pages_with_my_ink", lambda p: F.lpad(p.cast("string"), 3, "0")), ",").alias("ink"))
