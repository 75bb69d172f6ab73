"""Queries of records, files and pages."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import records as D
from ..operators import serve as V
from .register import ANNOTATIONS, ATTACHMENTS, ITEMS, annotations, attachments, items, query, table


@query(f"select att_id, case when att_id % 11 = 0 then 'ignored' when att_id % 7 = 0 then 'text' when att_id % 5 = 0 then 'pdf' when mime = 'text/plain' then 'text' when mime = 'application/pdf' then 'pdf' when att_id % 13 = 0 then 'ignored' else 'html' end AS route from ({ATTACHMENTS})")
def route_by_type(spark, sf):
    """By type, and by name where there is none."""
    k = F.col("att_id")
    a = attachments(spark, sf).withColumn("name", F.concat(F.lit("f"), F.when(k % 11 == 0, ".XML").when(k % 7 == 0, ".txt").when(k % 5 == 0, ".Pdf").otherwise("")))
    mime = F.when((k % 11 != 0) & ((k % 7 == 0) | (k % 5 == 0)), "").when((k % 13 == 0) & (F.col("mime") == "text/html"), "Text/XML").otherwise(F.col("mime"))
    return a.select("att_id", D.route(mime, F.col("name")).alias("route"))


_PAGES = r"select source, doc_id page, case when doc_id % 3 = 0 then '' when doc_id % 3 = 1 then left(text, 30) else text end text, case when doc_id % 2 = 0 then 0.001 else 0.2 end dark, doc_id % 30 words from documents"


def _pages(spark, sf):
    k = F.col("doc_id")
    return table(spark, sf, "documents").select("source", k.alias("page"), F.when(k % 3 == 0, "").when(k % 3 == 1, F.left("text", F.lit(30))).otherwise(F.col("text")).alias("text"), F.when(k % 2 == 0, 0.001).otherwise(0.2).alias("dark"), (k % 30).alias("words"))


@query(f"with n as (select *, length(regexp_replace(text, '\\s', '', 'g')) n from ({_PAGES})), c as (select *, case when n >= 50 then 'text' when n > 0 then 'short' when dark < 0.002 then 'blank' when words < 20 then 'plate' else 'needs OCR' end c from n) select source, page, case when c not in ('text', 'short') and coalesce(max(case when c = 'needs OCR' then 1 else 0 end) over (partition by source order by page rows between unbounded preceding and 1 preceding), 0) = 1 then 'unchecked' else c end AS class from c")
def page_class(spark, sf):
    """Pages without text, after one that needs recognition, aren't checked."""
    return D.page_classes(_pages(spark, sf), "source").select("source", "page", "class")


@query(f"select source, case when bool_and(length(regexp_replace(text, '\\s', '', 'g')) >= 50) then 'text' when bool_or(length(regexp_replace(text, '\\s', '', 'g')) >= 50) then 'mixed' else 'none (needs OCR)' end AS layer from ({_PAGES}) group by source")
def text_layer_class(spark, sf):
    return D.text_layers(_pages(spark, sf), "source")


@query("with s as (select source, lang, sum(n_chars) n, sum(n_chars * (doc_id % 10) / 10.0) c from documents group by all), t as (select *, n * 1.0 / sum(n) over (partition by source) share, sum(c) over (partition by source) / sum(n) over (partition by source) confidence, row_number() over (partition by source order by n desc, lang) k from s) select source, lang, round(share, 6) AS share, round(confidence, 6) AS confidence from t where share >= 0.02 or k = 1")
def language_confidence(spark, sf):
    parts = table(spark, sf, "documents").select("source", "lang", F.col("n_chars").alias("chars"), (F.col("doc_id") % 10 / 10.0).alias("confidence"))
    return D.language_shares(parts, "source").select("source", "lang", F.round("share", 6).alias("share"), F.round("confidence", 6).alias("confidence"))


@query(r"select doc_id, cast(n - case when doc_id % 4 = 0 then 0 else 5 end as bigint) AS got, cast(n as bigint) AS expected, case when n = 0 then false else 100.0 * (case when doc_id % 4 = 0 then 0 else 5 end) / n > 1 end AS flagged from (select doc_id, length(regexp_replace(text, '\s', '', 'g')) n from documents)")
def coverage_check(spark, sf):
    """Chunks of which five characters repeat, where documents aren't divisible by four; flagged where that is over one per cent."""
    d = table(spark, sf, "documents")
    chunks = d.select("doc_id", F.col("text").alias("chunk"), F.when(F.col("doc_id") % 4 == 0, 0).otherwise(5).alias("repeated"))
    return D.coverage(chunks, d.select("doc_id", T.nonws_len(F.col("text")).alias("expected")), "doc_id").select("doc_id", "got", "expected", "flagged")


_LABELLED = "select doc_id, cast(doc_id % 9 + 1 as int) n, cast(100 + doc_id % 50 as int) a, cast(doc_id % 4 as int) kind, cast(doc_id % 3 as int) extra from documents"


@query(f"""with c as (select *, a + n - 1 - case when extra = 1 then 1 when extra = 2 then 5 else 0 end b from ({_LABELLED})), d as (select * exclude (b), concat(cast(a as varchar), '-', cast(b as varchar)) field, case when b < 100 then 100 + b else b end b from c), e as (select *, b - a + 1 span from d),
 f as (select *, case when kind = 0 then 'pdf page labels' when b < a then 'none' when n = span then concat('pages field ', field, ' (exact match)') when n = span + 1 and n >= 3 and doc_id % 2 = 0 then concat('pages field ', field, ' (cover first)') when n = span + 1 and n >= 3 then concat('pages field ', field, ' (cover last)') else concat('pages field ', field, ': ', cast(span as varchar), ' pages vs PDF ', cast(n as varchar)) end how from e)
 select doc_id, case when kind = 1 then 'trivial pdf labels 1..n ignored; ' else '' end || how AS how, case when kind = 0 then 'r1' when how like '%exact match)' then cast(a as varchar) when how like '%cover first)' then '' when how like '%cover last)' then cast(a as varchar) else '' end AS first_label, n AS n_labels from f""")
def printed_pages(spark, sf):
    """Own labels, labels that just count, page fields that fit, that fit but for a cover sheet at either end, and that don't fit."""
    k = F.col("doc_id")
    n, a, kind, extra = ((k % 9) + 1).cast("int"), (100 + k % 50).cast("int"), k % 4, k % 3
    b = a + n - 1 - F.when(extra == 1, 1).when(extra == 2, 5).otherwise(0)
    counting = F.transform(F.sequence(F.lit(1), n), lambda i: i.cast("string"))
    labels = F.when(kind == 0, F.transform(counting, lambda x: F.concat(F.lit("r"), x))).when(kind == 1, counting)
    first, last = F.when(k % 2 == 0, 3).otherwise(1), F.when(k % 2 == 0, 1).otherwise(3)
    found, how = D.printed_labels(labels, n, F.lit(True), F.concat(a.cast("string"), F.lit("-"), b.cast("string")), first, last)
    return table(spark, sf, "documents").select("doc_id", how.alias("how"), found[0].alias("first_label"), F.size(found).alias("n_labels"))


@query(f"""with c as (select *, a + n - 1 - case when extra = 1 then 1 when extra = 2 then 5 else 0 end b from ({_LABELLED})), d as (select * exclude (b), case when b < 100 then 100 + b else b end b from c) select case when kind = 0 then 'pdf page labels' else case when kind = 1 then 'trivial pdf labels N..n ignored; ' else '' end || case when b < a then 'none' when n = b - a + 1 then 'pages field N-N (exact match)' when n = b - a + 2 and n >= 3 then case when doc_id % 2 = 0 then 'pages field N-N (cover first)' else 'pages field N-N (cover last)' end else 'pages field N-N: N pages vs PDF N' end end AS derivation, count(*) AS n from d group by 1""")
def derivation_histogram(spark, sf):
    return printed_pages(spark, sf).groupBy(D.derivation_key(F.col("how")).alias("derivation")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""select concat('meta:', cast(item_id as varchar)) AS source_id, 'metadata' AS source_type, concat_ws(chr(10), 'Title: ' || title, 'Authors: ' || surname, case when yr <> '' then 'Year: ' || yr end, 'Item type: ' || kind) AS chunk from ({ITEMS})
 union all select concat('ann:', ann_key), case when kind = 'highlight' then 'highlight' else 'note' end, case when trim(body) = '' and trim(remark) = '' then concat('Tagged note', case when page % 2 = 0 then concat(' on p. ', cast(page as varchar)) when page > 0 then concat(' on PDF p. ', cast(page as varchar)) else '' end, ': ', tags) else concat_ws(chr(10), case when trim(body) <> '' then 'Highlighted: ' || trim(body) end, case when trim(remark) <> '' then 'My comment: ' || trim(remark) end, case when tags <> '' then 'Tags: ' || tags end) end from ({ANNOTATIONS}) where kind <> 'ink' and (trim(body) <> '' or trim(remark) <> '' or tags <> '')
 union all select concat('note:', cast(conv_id as varchar), '-', cast(turn as varchar)), 'child_note', text from conversations
 union all select 'embedded:' || attachment_key, 'embedded', 'Highlighted: ' || body from (select distinct attachment_key, page, trim(body) body from ({ANNOTATIONS}) where trim(body) <> '')
 union all select concat('text:', cast(doc_id as varchar)), 'text_file', text from documents""")
def source_chunks(spark, sf):
    """All five kinds of sources as one table of chunks; texts as they are, one chunk each; embedded ones named by their attachment here."""
    cards = D.metadata_cards(items(spark, sf).select(F.col("item_id").alias("item_key"), "title", F.col("surname").alias("authors"), "yr", F.col("kind").alias("item_type")))
    ann = annotations(spark, sf).withColumn("printed", F.when(F.col("page") % 2 == 0, F.col("page").cast("string")).otherwise(""))
    native = D.annotation_chunks(ann)
    twice = ann.select("attachment_key", "page", F.trim("body").alias("body"), F.lit("").alias("remark"))
    embedded = D.embedded_chunks(twice.unionByName(twice)).withColumn("source_id", F.regexp_replace("source_id", ":[0-9a-f]{10}$", ""))
    notes = table(spark, sf, "conversations").select(F.concat(F.lit("note:"), "conv_id", F.lit("-"), "turn").alias("source_id"), F.lit("child_note").alias("source_type"), F.lit(1).alias("seq"), F.col("text").alias("chunk"))
    texts = table(spark, sf, "documents").select(F.concat(F.lit("text:"), "doc_id").alias("source_id"), F.lit("text_file").alias("source_type"), F.lit(1).alias("seq"), F.col("text").alias("chunk"))
    whole = cards
    for part in (native, notes, embedded, texts):
        whole = whole.unionByName(part)
    return whole.select("source_id", "source_type", "chunk")


@query(f"with f as (select att_id, cast(att_id // 4 as int) dir from ({ATTACHMENTS})), p as (select dir, count(*) n, min(att_id) o from f where att_id % 3 = 0 group by 1) select f.att_id, case when f.att_id % 3 = 0 then concat('s/', cast(f.dir as varchar), '/', cast(f.att_id as varchar), '.pdf') when p.n = 1 then concat('s/', cast(f.dir as varchar), '/', cast(p.o as varchar), '.pdf') end AS file from f left join p using (dir)")
def chosen_files(spark, sf):
    """Of four attachments in a folder only those divisible by three are there under their recorded names."""
    path = F.concat(F.lit("s/"), F.floor(F.col("att_id") / 4).cast("string"), F.lit("/"), F.col("att_id").cast("string"), F.lit(".pdf"))
    entries = attachments(spark, sf).select("att_id", path.alias("path"))
    return D.chosen_files(entries, entries.where("att_id % 3 = 0").select("path")).select("att_id", "file")


@query("select distinct o_custkey AS key from orders where o_custkey not in (select c_custkey from customer where c_custkey % 3 <> 0)")
def missing_keys(spark, sf):
    wanted = table(spark, sf, "orders").select(F.col("o_custkey").alias("key"))
    return D.missing_keys(wanted, table(spark, sf, "customer").where("c_custkey % 3 != 0").select(F.col("c_custkey").alias("key")), "key")


@query("with m as (select l_orderkey page, median(l_quantity) m from lineitem group by 1), n as (select l_orderkey page, l_linenumber x, l_quantity y from lineitem join m on l_orderkey = page where abs(l_quantity - m) <= 12), f as (select page, count(*) >= 3 and count(distinct x) > 1 ok, regr_slope(y, x) s, regr_intercept(y, x) i, median(y) m from n group by 1) select page, case when not ok or abs(s) < 5e-7 then 0.0 else round(s, 6) end AS slope, round(case when not ok then m when abs(i) < 5e-7 then 0 else i end, 6) AS intercept from f")
def least_squares_gutter(spark, sf):
    p = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").cast("double").alias("x"), F.col("l_quantity").alias("y"))
    return D.least_squares(p, ["page"], "x", "y", 12).select("page", (F.round("slope", 6) + 0.0).alias("slope"), (F.round("intercept", 6) + 0.0).alias("intercept"))


@query("select event_id, case event_id % 5 when 0 then 'last line' when 1 then concat('Page failed ', event_type) when 2 then concat('Page failed ', event_type, ' (ocrmypdf exit code 6)') when 3 then 'ocrmypdf failed with exit code 6' else 'no output' end AS line from events")
def last_error(spark, sf):
    """Logs without an error, with one, with an exit code behind another or alone, and an empty one."""
    bad, code = F.concat(F.lit(" Page failed "), "event_type"), F.lit("ocrmypdf failed with exit code 6")
    log = F.element_at(F.array(F.array(F.lit("start"), F.lit(" last line "), F.lit("Done: 3")), F.array(bad, F.lit("go on")), F.array(bad, code), F.array(F.lit("x"), code), F.array(F.lit(" "), F.lit("Done: error"))), (F.col("event_id") % 5 + 1).cast("int"))
    return table(spark, sf, "events").select("event_id", D.last_error_line(log).alias("line"))


@query("select vec_id, 0.25 AS dark from embeddings")
def dark_pixels(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", D.dark_share(F.unhex(F.lit("00ff80ff"))).alias("dark"))


@query("select l_orderkey AS page, l_linenumber AS y, l_quantity AS x, row_number() over (order by l_orderkey, l_linenumber, l_quantity, l_partkey) AS place from lineitem qualify place <= 500")
def page_order(spark, sf):
    """The first marks by page, then down and across the page."""
    from pyspark.sql import Window

    first = table(spark, sf, "lineitem").orderBy("l_orderkey", "l_linenumber", "l_quantity", "l_partkey").limit(500)
    w = Window.orderBy("l_orderkey", "l_linenumber", "l_quantity", "l_partkey")
    return first.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("y"), F.col("l_quantity").alias("x"), F.row_number().over(w).cast("long").alias("place"))


@query("select l_orderkey AS page, l_suppkey % 2 AS block, l_suppkey % 3 AS line, cast(min(l_linenumber) as int) AS top, string_agg(concat('w', cast(l_partkey as varchar)), ' ' order by l_linenumber, concat('w', cast(l_partkey as varchar))) AS text from lineitem where l_partkey % 10 <> 0 and l_quantity >= 10 group by all")
def tsv_lines(spark, sf):
    """Rows of a recognition table: words only, not blank, and sure enough."""
    x = table(spark, sf, "lineitem")
    words = x.select(F.col("l_orderkey").alias("page"), F.lit(5).alias("level"), (F.col("l_suppkey") % 2).alias("block"), F.lit(1).alias("par"), (F.col("l_suppkey") % 3).alias("line"), F.col("l_linenumber").alias("left"), F.col("l_linenumber").alias("top"), F.lit(4).alias("width"), F.lit(9).alias("height"), F.col("l_quantity").alias("conf"), F.when(F.col("l_partkey") % 10 == 0, "  ").otherwise(F.concat(F.lit("w"), "l_partkey")).alias("text"))
    heads = words.withColumn("level", F.lit(4))
    return D.text_lines(words.unionByName(heads), ["page"], 10).select("page", "block", "line", "top", "text")


@query("select conv_id AS item_key, concat('## A', cast(conv_id % 5 as varchar), ' (1990). *T', cast(conv_id as varchar), '*', chr(10), chr(10), string_agg(concat('- **p. ', cast(turn as varchar), '** · highlight', chr(10), '  > ', replace(text, chr(10), ' '), case when turn % 2 = 0 then concat(chr(10), chr(10), '  **Comment:** see') else '' end, chr(10)), chr(10) order by turn)) AS markdown from (select conv_id, turn, min(text) as text from conversations group by all) group by conv_id")
def ann_markdown(spark, sf):
    """Embedded annotations as Markdown by item: quotes on one line, comments behind them."""
    from ..sources.sinks import annotation_markdown

    c = table(spark, sf, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("body"))
    return annotation_markdown(c.select(F.col("conv_id").alias("item_key"), F.concat(F.lit("A"), (F.col("conv_id") % 5).cast("string")).alias("author"), F.lit("1990").alias("year"), F.concat(F.lit("T"), "conv_id").alias("title"), F.lit("a1").alias("attachment_key"), F.col("turn").alias("page"), F.lit("").alias("page_label"), F.lit("highlight").alias("kind"), "body", F.when(F.col("turn") % 2 == 0, "see").otherwise("").alias("remark"), F.col("turn").alias("place")))


@query("select (select count(*) from documents) AS chunks, (select count(distinct source) from documents) AS items, (select count(*) from documents) AS indexed")
def index_counts(spark, sf):
    """Rows of each part of the index."""
    from .retrieval import _library

    lib = _library(spark, sf)
    return lib.chunks.agg(F.count(F.lit(1)).alias("chunks")).join(F.broadcast(lib.items.agg(F.count(F.lit(1)).alias("items")))).withColumn("indexed", F.lit(lib.index.rows).cast("long"))


@query()
def answers(spark, sf):
    """One answer of each kind as the payload a caller gets."""
    from .retrieval import _library

    lib = _library(spark, sf)
    first = lib.chunks.orderBy("doc_id").first()
    named = replace(lib.index, postings=lib.index.postings.withColumn("id", F.col("id").cast("string")))
    lib = V.Library(lib.chunks.withColumn("chunk_id", F.col("doc_id").cast("string")), lib.items, named)
    given = [("search", lib.search("the trash", mode="keyword")), ("context", lib.get_context(str(first["doc_id"]))), ("item", lib.get_item(first["item_key"])), ("annotations", lib.list_annotations(tag="method")), ("items", lib.find_items("author"))]
    return spark.createDataFrame(given, "kind string, payload string")
