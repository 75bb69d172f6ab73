"""Queries of filters, joins, aggregations and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import library as L
from ..operators.index import word_counts
from .register import ANNOTATIONS, ATTACHMENTS, CHUNKS, ITEMS, MINE, SOURCE_TYPES, annotations, attachments, chunks, items, query, table

_MINE = ", ".join(f"'{m}'" for m in MINE)


def _tagged(c):
    return c.withColumn("tags", F.array(F.concat(F.lit("t"), (F.col("doc_id") % 5).cast("string")), F.concat(F.lit("t"), (F.col("doc_id") % 3).cast("string"))))


@query(f"select chunk_id, yr, lang from ({CHUNKS}) where source_type in ('pdf_text', 'note', 'snapshot') and lang in ('en', 'fr') and (concat('t', cast(doc_id % 5 as varchar)) in ('t2', 't4') or concat('t', cast(doc_id % 3 as varchar)) in ('t2', 't4')) and try_cast(yr as int) between 1450 and 1900")
def filter_candidates(spark, sf):
    c = L.metadata_filter(_tagged(chunks(spark, sf)), types=("pdf_text", "note", "snapshot"), languages=("en", "fr"), tags=("T2", "t4"), year_from=1450, year_to=1900, known_types=SOURCE_TYPES)
    return c.select("chunk_id", "yr", "lang")


@query(f"select chunk_id from ({CHUNKS}) where regexp_full_match(yr, '[0-9]+') and try_cast(yr as int) >= 1700")
def filter_year_range(spark, sf):
    return L.metadata_filter(chunks(spark, sf), year_from=1700, year_to=0).select("chunk_id")


@query(f"select ann_key from ({ANNOTATIONS}) where body <> '' or remark <> '' or tags <> ''")
def ann_has_content(spark, sf):
    return annotations(spark, sf).where((F.col("body") != "") | (F.col("remark") != "") | (F.col("tags") != "")).select("ann_key")


@query(f"select ann_key, page, count(*) over () AS total from ({ANNOTATIONS}) where kind in ('highlight', 'note') and remark <> '' and list_contains(list_transform(string_split(tags, ';'), lambda t: lower(trim(t))), 'tag1') order by attachment_key, page, ann_key limit 25 offset 10")
def list_annotations(spark, sf):
    a = annotations(spark, sf).where(F.col("kind").isin("highlight", "note") & (F.col("remark") != "") & F.array_contains(T.split_tags(F.col("tags")), "tag1"))
    total = a.agg(F.count(F.lit(1)).alias("total"))
    return a.join(F.broadcast(total)).orderBy("attachment_key", "page", "ann_key").offset(10).limit(25).select("ann_key", "page", "total")


@query(f"select item_id, surname, yr from ({ITEMS}) where list_contains(list_filter(string_split_regex(lower(concat_ws(' ', title, surname, yr)), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), 'author7') and contains(lower(concat_ws(' ', title, surname, yr)), 'custo') order by lower(surname), yr, item_id limit 100")
def find_items(spark, sf):
    hay = F.concat_ws(" ", "title", "surname", "yr")
    found = items(spark, sf).where(F.array_contains(T.word_list(hay), "author7") & L.matches_all_words(hay, "custo"))
    return found.orderBy(F.lower("surname"), "yr", "item_id").limit(100).select("item_id", "surname", "yr")


@query(f"select chunk_id, source_type, item_key, case when source_type = 'pdf_text' then pdf_page else 0 end AS page, nullif(yr, '') AS year from ({CHUNKS})")
def search_result_projection(spark, sf):
    return chunks(spark, sf).select("chunk_id", "source_type", "item_key", F.when(F.col("source_type") == "pdf_text", F.col("pdf_page")).otherwise(0).alias("page"), F.nullif("yr", F.lit("")).alias("year"))


@query(f"select chunk_id, case when source_type in ('pdf_text', 'snapshot') then 'author' when source_type = 'text_file' then 'edition' when source_type = 'metadata' then 'record' when source_type = 'child_note' then 'my note' when doc_id % 3 = 0 then 'my highlight' when doc_id % 3 = 1 then 'my highlight with comment' else 'my comment' end AS voice from ({CHUNKS})")
def voice_class(spark, sf):
    """By kind, and for marks by what their text begins with."""
    mark = F.element_at(F.array(F.lit("Highlighted: a"), F.lit("Highlighted: a\nMy comment: b"), F.lit("My comment: b")), (F.col("doc_id") % 3 + 1).cast("int"))
    return chunks(spark, sf).select("chunk_id", T.voice(F.col("source_type"), mark).alias("voice"))


@query(f"select item_id, coalesce(nullif(yr, ''), nullif(surname, ''), title) AS first_known, title, surname from ({ITEMS})")
def item_base_meta(spark, sf):
    return items(spark, sf).select("item_id", F.coalesce(F.nullif("yr", F.lit("")), F.nullif("surname", F.lit("")), "title").alias("first_known"), "title", "surname")


@query("with s as (select source, lang, count(*) n from documents group by all), t as (select source, lang, n, n * 1.0 / sum(n) over (partition by source) share, row_number() over (partition by source order by n desc, lang) k from s) select source, string_agg(lang, '+' order by lang) AS languages, count(*) AS n_languages from t where share >= 0.02 or k = 1 group by source")
def plan_rows(spark, sf):
    from pyspark.sql import Window

    s = table(spark, sf, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("source")
    t = s.withColumn("share", F.col("n") / F.sum("n").over(w)).withColumn("k", F.row_number().over(w.orderBy(F.desc("n"), "lang"))).where("share >= 0.02 or k = 1")
    return t.groupBy("source").agg(F.array_join(F.array_sort(F.collect_list("lang")), "+").alias("languages"), F.count(F.lit(1)).alias("n_languages"))


# joins


@query(f"select i.item_id, count(a.att_id) AS n_attachments, count(*) filter (where a.mime = 'application/pdf') AS n_pdf from ({ITEMS}) i left join ({ATTACHMENTS}) a using (item_id) group by 1")
def join_items_children(spark, sf):
    a = attachments(spark, sf).groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("mime") == "application/pdf").alias("p"))
    return items(spark, sf).join(a, "item_id", "left").select("item_id", F.coalesce("n", F.lit(0)).alias("n_attachments"), F.coalesce("p", F.lit(0)).alias("n_pdf"))


@query(f"select ann_key from ({ANNOTATIONS}) where conv_id in (select att_id from ({ATTACHMENTS}) where mime = 'application/pdf')")
def semi_annotations(spark, sf):
    a = attachments(spark, sf).where(F.col("mime") == "application/pdf").select(F.col("att_id").alias("conv_id"))
    return annotations(spark, sf).join(a, "conv_id", "left_semi").select("ann_key")


@query(f"select attachment_key, count(*) AS n, min(page) AS first_page from ({ANNOTATIONS}) group by 1")
def ann_by_parent(spark, sf):
    return annotations(spark, sf).groupBy("attachment_key").agg(F.count(F.lit(1)).alias("n"), F.min("page").alias("first_page"))


@query(f"with plan as (select att_id from ({ATTACHMENTS}) where att_id % 3 = 0), manifest as (select att_id from ({ATTACHMENTS}) where att_id % 7 = 0) select min(att_id) AS att_id, item_id from ({ATTACHMENTS}) where att_id not in (select att_id from plan) and att_id not in (select att_id from manifest) group by item_id")
def anti_new_rows(spark, sf):
    a = attachments(spark, sf)
    known = a.where("att_id % 3 = 0").select("att_id").union(a.where("att_id % 7 = 0").select("att_id"))
    new = a.join(known, "att_id", "left_anti")
    return L.first_of_each(new, ["item_id"], [F.col("att_id")]).select("att_id", "item_id")


@query(f"select att_id from ({ATTACHMENTS}) where mode <> 3 and mime = 'application/pdf' and att_id not in (select att_id from ({ATTACHMENTS}) where att_id % 4 = 0)")
def ocr_targets(spark, sf):
    a = attachments(spark, sf)
    return a.where((F.col("mode") != 3) & (F.col("mime") == "application/pdf")).join(a.where("att_id % 4 = 0").select("att_id"), "att_id", "left_anti").select("att_id")


@query(f"with k as (select ann_key, turn, regexp_replace(lower(body), '[^\\p{{L}}\\p{{N}}_]+', '', 'g') norm, kind from ({ANNOTATIONS})) select ann_key from k a where kind = 'highlight' and not exists (select 1 from k b where b.kind = 'note' and b.turn = a.turn + 1 and b.norm = a.norm)")
def anti_dup_annotations(spark, sf):
    k = annotations(spark, sf).select("ann_key", "turn", T.norm_ann(F.col("body")).alias("norm"), "kind")
    native = k.where("kind = 'note'").select((F.col("turn") - 1).alias("turn"), "norm")
    return k.where("kind = 'highlight'").join(native, ["turn", "norm"], "left_anti").select("ann_key")


@query(f"select att_id, case when att_id % 6 = 0 then concat('ocr/', cast(att_id as varchar)) else concat('storage/', cast(att_id as varchar)) end AS path, att_id % 6 = 0 AS ocr from ({ATTACHMENTS}) where mime = 'application/pdf'")
def ocr_substitution(spark, sf):
    a = attachments(spark, sf).where(F.col("mime") == "application/pdf").select("att_id")
    copies = a.where("att_id % 6 = 0").select("att_id", F.concat(F.lit("ocr/"), "att_id").alias("copy"))
    return a.join(copies, "att_id", "left").select("att_id", F.coalesce("copy", F.concat(F.lit("storage/"), "att_id")).alias("path"), F.col("copy").isNotNull().alias("ocr"))


@query(f"select chunk_id, length(text) AS n from ({CHUNKS}) where doc_id % 50 = 0")
def texts_by_ids(spark, sf):
    c = chunks(spark, sf)
    wanted = table(spark, sf, "documents").select("doc_id").where("doc_id % 50 = 0")
    return c.join(wanted, "doc_id", "left_semi").select("chunk_id", F.length("text").cast("long").alias("n"))


@query("with calls as (select event_id % 100 note, event_id % 7 chapter from events where event_type = 'click'), defs as (select event_id % 90 note, event_id % 7 chapter from events where event_type = 'view'), c as (select chapter, note, count(*) n from calls group by all), d as (select chapter, note from defs group by all) select coalesce(c.chapter, d.chapter) AS chapter, count(*) filter (where d.note is null) AS undefined, count(*) filter (where c.note is null) AS uncalled, count(*) filter (where c.n > 1) AS repeated from c full join d on c.chapter = d.chapter and c.note = d.note group by 1")
def footnote_audit(spark, sf):
    e = table(spark, sf, "events")
    c = e.where("event_type = 'click'").groupBy((F.col("event_id") % 7).alias("chapter"), (F.col("event_id") % 100).alias("note")).agg(F.count(F.lit(1)).alias("calls"))
    d = e.where("event_type = 'view'").select((F.col("event_id") % 7).alias("chapter"), (F.col("event_id") % 90).alias("note"), F.lit(True).alias("defined")).distinct()
    return c.join(d, ["chapter", "note"], "full_outer").groupBy("chapter").agg(F.count_if(F.col("defined").isNull()).alias("undefined"), F.count_if(F.col("calls").isNull()).alias("uncalled"), F.count_if(F.col("calls") > 1).alias("repeated"))


@query(f"with f as (select attachment_key, page, count(*) filter (where body <> '' or remark <> '') n, bool_or(kind = 'ink') ink from ({ANNOTATIONS}) group by all), p as (select distinct concat('att', cast(doc_id % 50 as varchar)) attachment_key, cast(doc_id % 12 as int) page from documents) select attachment_key, page, coalesce(n, 0) AS n_annotations, coalesce(ink, false) AS has_ink from p left join f using (attachment_key, page)")
def page_flags(spark, sf):
    f = annotations(spark, sf).groupBy("attachment_key", "page").agg(F.count_if((F.col("body") != "") | (F.col("remark") != "")).alias("n"), F.bool_or(F.col("kind") == "ink").alias("ink"))
    p = table(spark, sf, "documents").select(F.concat(F.lit("att"), F.col("doc_id") % 50).alias("attachment_key"), (F.col("doc_id") % 12).cast("int").alias("page")).distinct()
    return p.join(f, ["attachment_key", "page"], "left").select("attachment_key", "page", F.coalesce("n", F.lit(0)).alias("n_annotations"), F.coalesce("ink", F.lit(False)).alias("has_ink"))


# aggregations


@query(f"select source_type, count(*) AS n from ({CHUNKS}) group by 1")
def count_by_type(spark, sf):
    return chunks(spark, sf).groupBy("source_type").agg(F.count(F.lit(1)).alias("n"))


@query(f"select item_key, string_agg(concat(source_type, '=', cast(n as varchar)), ', ' order by source_type) AS counts from (select item_key, source_type, count(*) n from ({CHUNKS}) group by all) group by 1")
def item_type_counts(spark, sf):
    c = chunks(spark, sf).groupBy("item_key", "source_type").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("item_key").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.col("source_type"), F.lit("="), "n"))), ", ").alias("counts"))


@query(f"select attachment_key, count(*) AS n_chunks, bool_or(doc_id % 9 = 0) AS ocr, count(distinct pdf_page) AS n_pages, string_agg(distinct case when doc_id % 4 = 0 then lpad(cast(pdf_page as varchar), 3, '0') end, ',' order by case when doc_id % 4 = 0 then lpad(cast(pdf_page as varchar), 3, '0') end) AS ink_pages from ({CHUNKS}) group by 1")
def attachment_rollup(spark, sf):
    ink = F.when(F.col("doc_id") % 4 == 0, F.lpad(F.col("pdf_page").cast("string"), 3, "0"))
    return chunks(spark, sf).groupBy("attachment_key").agg(F.count(F.lit(1)).alias("n_chunks"), F.bool_or(F.col("doc_id") % 9 == 0).alias("ocr"), F.count_distinct("pdf_page").alias("n_pages"), F.nullif(F.array_join(F.array_sort(F.collect_set(ink)), ","), F.lit("")).alias("ink_pages"))


@query(f"select count(*) AS attachments, count(*) filter (where mime = 'application/pdf') AS pdf, count(*) filter (where mode = 3) AS links, count(*) filter (where size > 200000) AS large, count(distinct item_id) AS items from ({ATTACHMENTS})")
def audit_summary(spark, sf):
    return attachments(spark, sf).agg(F.count(F.lit(1)).alias("attachments"), F.count_if(F.col("mime") == "application/pdf").alias("pdf"), F.count_if(F.col("mode") == 3).alias("links"), F.count_if(F.col("size") > 200000).alias("large"), F.count_distinct("item_id").alias("items"))


@query(r"with w as (select source, doc_id, unnest(regexp_extract_all(lower(text), '\p{L}{3,}')) word from documents), df as (select source, word, count(distinct doc_id) n from w group by all) select source, doc_id, round(avg(case when n - 1 >= 3 then 1.0 else 0.0 end), 6) AS score from w join df using (source, word) group by all")
def page_vocab_score(spark, sf):
    from pyspark.sql import Window

    # a page's words are counted within its row, so only distinct words of a page are ever shuffled, once
    words = table(spark, sf, "documents").select(F.struct("source", "doc_id").alias("page"), F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}{3,})"), 1).alias("w"))
    each = word_counts(words, "page", "w").select("page.source", "page.doc_id", "term", "tf")
    spread = F.count(F.lit(1)).over(Window.partitionBy("source", "term"))
    shared = F.sum(F.when(F.col("n") - 1 >= 3, F.col("tf")).otherwise(0)) / F.sum("tf")
    return each.withColumn("n", spread).groupBy("source", "doc_id").agg(F.round(shared, 6).alias("score"))


@query("with s as (select source, lang, sum(n_chars) n from documents group by all), t as (select *, round(100.0 * n / sum(n) over (partition by source)) pct, row_number() over (partition by source order by n desc, lang) k from s) select source, string_agg(concat(lang, ' ', cast(cast(pct as int) as varchar), '%'), ', ' order by k) AS shares from t where k <= 2 group by 1")
def language_shares(spark, sf):
    from pyspark.sql import Window

    s = table(spark, sf, "documents").groupBy("source", "lang").agg(F.sum("n_chars").alias("n"))
    w = Window.partitionBy("source")
    t = s.select("source", "lang", F.round(100.0 * F.col("n") / F.sum("n").over(w)).cast("int").alias("pct"), F.row_number().over(w.orderBy(F.desc("n"), "lang")).alias("k")).where("k <= 2")
    named = F.transform(F.array_sort(F.collect_list(F.struct("k", F.concat(F.col("lang"), F.lit(" "), F.col("pct").cast("string"), F.lit("%")).alias("s")))), lambda x: x["s"])
    return t.groupBy("source").agg(F.array_join(named, ", ").alias("shares"))


@query(f"select kind, count(*) AS n, count(*) filter (where remark <> '') AS with_comment from ({ANNOTATIONS}) group by 1")
def ann_type_counts(spark, sf):
    return annotations(spark, sf).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("remark") != "").alias("with_comment"))


@query(f"select split_part(source_type, '_', 1) AS kind, item_key, count(*) AS n from ({CHUNKS}) group by all")
def preview_counts(spark, sf):
    return chunks(spark, sf).groupBy(F.split_part("source_type", F.lit("_"), F.lit(1)).alias("kind"), "item_key").agg(F.count(F.lit(1)).alias("n"))


@query(f"select item_key, string_agg(distinct source_type, '; ' order by source_type) AS types from ({CHUNKS}) group by 1")
def joined_tags(spark, sf):
    return chunks(spark, sf).groupBy("item_key").agg(F.array_join(F.array_sort(F.collect_set("source_type")), "; ").alias("types"))


# sorting, paging and sets


@query(f"select ann_key, page from ({ANNOTATIONS}) order by case when attachment_key = '' then '~' else attachment_key end, case when page = 0 then 1000000 else page end, ann_key limit 40 offset 60")
def page_annotations(spark, sf):
    a = annotations(spark, sf)
    return a.orderBy(F.coalesce(F.nullif("attachment_key", F.lit("")), F.lit("~")), F.coalesce(F.nullif("page", F.lit(0)), F.lit(1_000_000)), "ann_key").offset(60).limit(40).select("ann_key", "page")


@query(f"select ann_key, row_number() over (partition by attachment_key order by case when page = 0 then 1000000 else page end, ann_key) AS place from ({ANNOTATIONS})")
def annotation_order(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("attachment_key").orderBy(F.coalesce(F.nullif("page", F.lit(0)), F.lit(1_000_000)), "ann_key")
    return annotations(spark, sf).select("ann_key", F.row_number().over(w).cast("long").alias("place"))


@query("select doc_id, n_chars from documents order by n_chars desc, doc_id limit 48")
def longest_rows(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(48)


@query("select o_custkey AS key from orders where o_orderkey % 2 = 0 except select o_custkey from orders where o_orderkey % 3 = 0")
def set_difference(spark, sf):
    o = table(spark, sf, "orders")
    return o.where("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("key")).distinct().join(o.where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("key")), "key", "left_anti")


@query(f"select chunk_id, array_to_string(list_sort(list_distinct([concat('t', cast(doc_id % 5 as varchar)), concat('t', cast(doc_id % 3 as varchar)), 'all'])), ',') AS all_tags from ({CHUNKS}) where doc_id % 5 = 1 or doc_id % 3 = 1")
def tags_overlap(spark, sf):
    c = _tagged(chunks(spark, sf)).where(F.arrays_overlap("tags", F.array(F.lit("t1"))))
    return c.select("chunk_id", F.array_join(F.array_sort(F.array_union("tags", F.array(F.lit("all")))), ",").alias("all_tags"))


@query("select text_key, min(doc_id) AS doc_id from (select md5(text) text_key, doc_id from documents) group by 1")
def dedup_first(spark, sf):
    d = table(spark, sf, "documents").select(F.md5("text").alias("text_key"), "doc_id")
    return d.groupBy("text_key").agg(F.min("doc_id").alias("doc_id"))


@query(f"select item_id, title, string_agg(cast(att_id as varchar), '; ' order by att_id) AS attachments from ({ITEMS}) join ({ATTACHMENTS}) using (item_id) group by all")
def items_table(spark, sf):
    a = attachments(spark, sf).groupBy("item_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("att_id")), lambda x: x.cast("string")), "; ").alias("attachments"))
    return items(spark, sf).join(a, "item_id").select("item_id", "title", "attachments")


@query("with recursive t as (select n_nationkey k, n_name path, 1 depth, n_nationkey root from nation where n_nationkey < 5 union all select c.n_nationkey, concat(t.path, ' / ', c.n_name), t.depth + 1, t.root from nation c join t on c.n_nationkey >= 5 and cast(floor(c.n_nationkey / 5) as int) = t.k) select cast(k as varchar) AS key, path, depth from t union all select 'root', '(Library root)', 0")
def tree_paths(spark, sf):
    n = table(spark, sf, "nation")
    nodes = n.select(F.col("n_nationkey").cast("string").alias("key"), F.col("n_name").alias("name"), F.when(F.col("n_nationkey") < 5, "root").otherwise(F.floor(F.col("n_nationkey") / 5).cast("string")).alias("parent"))
    root = spark.range(1).select(F.lit("root").alias("key"), F.lit("Library").alias("name"), F.lit(None).cast("string").alias("parent"))
    return L.collection_paths(spark, nodes.unionByName(root), "root")


@query("select range AS position, cast(floor(range / 100) as bigint) AS page, concat('item', cast(range as varchar)) AS item_key, concat('Title ', cast(range as varchar)) AS title from range(0, 389)")
def src_paged_items(spark, sf):
    """A listing of 389 items, a hundred a page, through a fetcher that needs no network."""
    from ..sources.library import PagedItems

    spark.dataSource.register(PagedItems)
    rows = spark.read.format("paged_items").option("fetch", "lexiloom.sources.library:numbered_items").option("path", "389").load()
    return rows.select("position", "page", "item_key", F.get_json_object("record", "$.data.title").alias("title"))


@query("with k as (select source, doc_id, text, length(concat('{\"source\":\"', source, '\",\"doc_id\":', cast(doc_id as varchar), ',\"body\":\"', repeat('x', least(n_chars, 6000)), '\"}')) size from documents), s as (select *, sum(size) over (partition by source order by doc_id rows unbounded preceding) run, row_number() over (partition by source order by doc_id) no from k) select source, doc_id, case when size > 4000 then concat(repeat('x', greatest(500, least(length(text), 6000) - (size - 4000))), ' […]') else repeat('x', least(length(text), 6000)) end AS body from s where run <= 4000 or no = 1")
def capped_results(spark, sf):
    """The rows of each source whose JSON stays within 4,000 characters together; a first row that is too long alone is cut."""
    rows = table(spark, sf, "documents").select("source", "doc_id", F.repeat(F.lit("x"), F.least(F.col("n_chars"), F.lit(6000)).cast("int")).alias("body"))
    return L.capped(rows, [F.col("doc_id")], ["source"], "body", 4000)


@query(f"with m as (select att_id, item_id, 1 v from ({ATTACHMENTS}) where att_id % 4 = 0), n as (select att_id, item_id, 2 v from ({ATTACHMENTS}) where att_id % 6 = 0) select * from n union all select * from m where att_id not in (select att_id from n)")
def manifest_upsert(spark, sf):
    from ..operators.sync import upsert

    a = attachments(spark, sf).select("att_id", "item_id")
    return upsert(a.where("att_id % 4 = 0").withColumn("v", F.lit(1)), a.where("att_id % 6 = 0").withColumn("v", F.lit(2)), ["att_id"])


@query(f"select item_id, title, nullif(yr, '') AS year, n_att AS n_attachments, n_pdf, total_size from ({ITEMS}) join (select item_id, count(*) n_att, count(*) filter (where mime = 'application/pdf') n_pdf, round(sum(size), 2) total_size from ({ATTACHMENTS}) group by 1) using (item_id)")
def get_item(spark, sf):
    a = attachments(spark, sf).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_attachments"), F.count_if(F.col("mime") == "application/pdf").alias("n_pdf"), F.round(F.sum("size"), 2).alias("total_size"))
    return items(spark, sf).join(a, "item_id").select("item_id", "title", F.nullif("yr", F.lit("")).alias("year"), "n_attachments", "n_pdf", "total_size")
