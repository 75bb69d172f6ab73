"""Queries of the operators on ordered rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import ordered as O
from .register import CHUNKS, chunks, query, table


def _file():
    """Documents of a source stand for the pages of files, 500 each: what runs over pages runs within a file."""
    return F.floor(F.col("doc_id") / 500)


@query("select attachment_key, raw_label AS label, seq from (select concat(source, '') attachment_key, doc_id seq, cast(cast(floor(doc_id / 40) as bigint) % 9 as varchar) raw_label, lag(cast(cast(floor(doc_id / 40) as bigint) % 9 as varchar)) over (partition by source, doc_id // 500 order by doc_id) prev from documents) where raw_label = prev")
def repeated_labels(spark, sf):
    d = table(spark, sf, "documents").select(F.col("source").alias("attachment_key"), F.col("doc_id").alias("seq"), (F.floor(F.col("doc_id") / 40) % 9).cast("string").alias("label"))
    return d.withColumn("prev", F.lag("label").over(Window.partitionBy("attachment_key", F.floor(F.col("seq") / 500)).orderBy("seq"))).where("label = prev").drop("prev")


@query("select doc_id, source, last_value(h ignore nulls) over (partition by source, doc_id // 500 order by doc_id rows unbounded preceding) AS heading from (select doc_id, source, case when doc_id % 6 = 0 then concat('Section ', cast(doc_id as varchar)) end h from documents)")
def carry_heading(spark, sf):
    h = F.when(F.col("doc_id") % 6 == 0, F.concat(F.lit("Section "), "doc_id"))
    return table(spark, sf, "documents").select("doc_id", "source", O.carried(h, ["source", _file()], ["doc_id"]).alias("heading"))


@query("with y as (select doc_id, source, case when n_chars % 5 = 0 then cast(1000 + n_chars % 700 as int) end y from documents), c as (select doc_id, source, y, last_value(y ignore nulls) over (partition by source, doc_id // 500 order by doc_id rows unbounded preceding) yr, last_value(y ignore nulls) over (partition by source, doc_id // 500 order by doc_id rows between unbounded preceding and 1 preceding) before from y) select doc_id, coalesce(yr, 0) AS year, coalesce(y < before, false) AS backwards from c")
def carry_year(spark, sf):
    y = F.when(F.col("n_chars") % 5 == 0, (1000 + F.col("n_chars") % 700).cast("int"))
    w = Window.partitionBy("source", _file()).orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    return table(spark, sf, "documents").select("doc_id", F.coalesce(O.carried(y, ["source", _file()], ["doc_id"]), F.lit(0)).alias("year"), F.coalesce(y < F.last_value(y, ignoreNulls=True).over(w), F.lit(False)).alias("backwards"))


@query("with r as (select l_orderkey, l_linenumber, case when l_linenumber % 3 = 1 then cast(l_linenumber + case when l_orderkey % 5 = 0 and l_linenumber > 3 then 1 else 0 end as int) end n from lineitem), k as (select *, row_number() over (partition by l_orderkey order by l_linenumber, n nulls first) r from r), b as (select *, last_value(case when n is not null then n end ignore nulls) over w1 ln, last_value(case when n is not null then r end ignore nulls) over w1 lr, first_value(case when n is not null then n end ignore nulls) over w2 hn, first_value(case when n is not null then r end ignore nulls) over w2 hr from k window w1 as (partition by l_orderkey order by r rows unbounded preceding), w2 as (partition by l_orderkey order by r rows between current row and unbounded following)) select l_orderkey, cast(r as int) AS place, cast(coalesce(n, case when hn - ln = hr - lr then ln + r - lr end, -1) as int) AS verse from b")
def gap_fill(spark, sf):
    line = F.col("l_linenumber")
    n = F.when(line % 3 == 1, (line + F.when((F.col("l_orderkey") % 5 == 0) & (line > 3), 1).otherwise(0)).cast("int"))
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", n.alias("n"))
    order = ["l_linenumber", F.col("n").asc_nulls_first()]
    w = Window.partitionBy("l_orderkey").orderBy(*order)
    placed = rows.withColumn("place", F.row_number().over(w))
    return placed.select("l_orderkey", "place", F.coalesce(O.gap_filled(F.col("n"), ["l_orderkey"], ["place"]), F.lit(-1)).cast("int").alias("verse"))


@query("with m as (select source, doc_id n, lead(doc_id) over (partition by source, doc_id // 500 order by doc_id) nxt from documents) select source, n AS first_page, case when nxt > n + 1 then concat(cast(n as varchar), '–', cast(nxt - 1 as varchar)) else cast(n as varchar) end AS label from m")
def lead_ranges(spark, sf):
    m = table(spark, sf, "documents").select("source", F.col("doc_id").alias("first_page"), F.lead("doc_id").over(Window.partitionBy("source", _file()).orderBy("doc_id")).alias("nxt"))
    n = F.col("first_page")
    return m.select("source", "first_page", F.when(F.col("nxt") > n + 1, F.concat(n.cast("string"), F.lit("–"), (F.col("nxt") - 1).cast("string"))).otherwise(n.cast("string")).alias("label"))


@query("with s as (select p_brand col, p_size n, lag(p_size) over (partition by p_brand order by p_partkey) prev from part) select col, count(*) AS words, count(*) filter (where n = prev + 1) AS steps, count(*) filter (where n = prev + 1) * 2 > count(*) AS counts_lines from s group by 1")
def line_number_columns(spark, sf):
    s = table(spark, sf, "part").select(F.col("p_brand").alias("col"), F.col("p_size").alias("n"), F.lag("p_size").over(Window.partitionBy("p_brand").orderBy("p_partkey")).alias("prev"))
    steps = F.count_if(F.col("n") == F.col("prev") + 1)
    return s.groupBy("col").agg(F.count(F.lit(1)).alias("words"), steps.alias("steps"), (steps * 2 > F.count(F.lit(1))).alias("counts_lines"))


@query("with d as (select distinct user_id, event_id % 60 n from events), r as (select user_id, n, n - row_number() over (partition by user_id order by n) g from d), i as (select user_id, min(n) a, max(n) b from r group by user_id, g) select user_id, string_agg(case when a = b then cast(a as varchar) else concat(cast(a as varchar), '-', cast(b as varchar)) end, ', ' order by a) AS ranges from i group by 1")
def page_ranges(spark, sf):
    e = table(spark, sf, "events").select("user_id", (F.col("event_id") % 60).alias("n"))
    return O.range_list(O.islands(e, ["user_id"], "n"), ["user_id"])


@query("with g as (select source, doc_id b, lag(doc_id) over (partition by source, doc_id // 500 order by doc_id) a from documents) select source, concat(cast(a as varchar), '->', cast(b as varchar)) AS step from g where b <> a + 1")
def numbering_gaps(spark, sf):
    g = table(spark, sf, "documents").select("source", F.col("doc_id").alias("b"), F.lag("doc_id").over(Window.partitionBy("source", _file()).orderBy("doc_id")).alias("a"))
    return g.where("b <> a + 1").select("source", F.concat(F.col("a"), F.lit("->"), F.col("b")).alias("step"))


@query("with q as (select l_orderkey page, l_linenumber id, l_quantity top, l_quantity + 12 bottom from lineitem), s as (select *, lag(top) over w pt, lag(bottom) over w pb from q window w as (partition by page order by top, id)), n as (select *, case when pt is null then 0 when least(bottom, pb) - greatest(top, pt) <= least(bottom - top, pb - pt) / 2 then 1 else 0 end new from s) select page, id, cast(sum(new) over (partition by page order by top, id rows unbounded preceding) as bigint) AS line from n")
def quad_lines(spark, sf):
    q = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("id"), F.col("l_quantity").alias("top"), (F.col("l_quantity") + 12).alias("bottom"))
    w = Window.partitionBy("page").orderBy("top", "id")
    s = q.withColumn("pt", F.lag("top").over(w)).withColumn("pb", F.lag("bottom").over(w))
    new = F.least("bottom", "pb") - F.greatest("top", "pt") <= F.least(F.col("bottom") - F.col("top"), F.col("pb") - F.col("pt")) / 2
    return s.select("page", "id", O.block_number(F.col("pt").isNotNull() & new, ["page"], ["top", "id"]).alias("line"))


@query("with l as (select o_custkey page, o_orderkey line, o_totalprice y, o_totalprice - lag(o_totalprice) over (partition by o_custkey order by o_totalprice, o_orderkey) pitch from orders), m as (select page, line, quantile_cont(pitch, 0.5) over (partition by page order by y, line rows between 3 preceding and 2 following) med from l) select page, line, round(med, 4) AS pitch, coalesce(med > 20000, false) AS wide from m")
def line_pitch_class(spark, sf):
    order = ["o_totalprice", "o_orderkey"]
    w = Window.partitionBy("o_custkey").orderBy(*order)
    o = table(spark, sf, "orders").withColumn("pitch", F.col("o_totalprice") - F.lag("o_totalprice").over(w))
    med = F.percentile("pitch", F.lit(0.5)).over(w.rowsBetween(-3, 2))
    return o.select(F.col("o_custkey").alias("page"), F.col("o_orderkey").alias("line"), F.round(med, 4).alias("pitch"), F.coalesce(med > 20000, F.lit(False)).alias("wide"))


@query("with p as (select o_custkey g, cast(o_orderkey % 1000 as double) x, o_totalprice y from orders), s as (select a.g, quantile_cont((b.x - a.x) / (b.y - a.y), 0.5) slope from p a join p b on a.g = b.g and b.y - a.y > 200 group by 1) select g, round(any_value(slope), 9) AS slope, round(quantile_cont(x - slope * y, 0.25), 4) AS intercept from p join s using (g) group by 1")
def theil_sen_edge(spark, sf):
    p = table(spark, sf, "orders").select(F.col("o_custkey").alias("g"), (F.col("o_orderkey") % 1000).cast("double").alias("x"), F.col("o_totalprice").alias("y"))
    return O.theil_sen(p, ["g"], "x", "y", 200).select("g", F.round("slope", 9).alias("slope"), F.round("intercept", 4).alias("intercept"))


@query("with w as (select l_orderkey page, l_linenumber word, l_quantity l, l_quantity + 10 r, l_linenumber * 10.0 t, l_linenumber * 10.0 + 8 b from lineitem), q as (select l_orderkey page, l_linenumber quad, l_quantity - 3 l, l_quantity + 9 r, l_linenumber * 10.0 - 1 t, l_linenumber * 10.0 + 13 b from lineitem) select w.page, word, min(quad) AS quad from w join q on w.page = q.page and least(w.r, q.r) > greatest(w.l, q.l) and least(w.b, q.b) > greatest(w.t, q.t) and (least(w.r, q.r) - greatest(w.l, q.l)) * (least(w.b, q.b) - greatest(w.t, q.t)) >= 0.5 * (w.r - w.l) * (w.b - w.t) group by all")
def ann_words_under_quads(spark, sf):
    x = table(spark, sf, "lineitem")
    top, left = F.col("l_linenumber") * 10.0, F.col("l_quantity")
    words = x.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("word"), left.alias("left"), (left + 10).alias("right"), top.alias("top"), (top + 8).alias("bottom"))
    quads = x.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("quad"), (left - 3).alias("q_left"), (left + 9).alias("q_right"), (top - 1).alias("q_top"), (top + 13).alias("q_bottom"))
    return O.overlap_assign(words, quads, ["page"], "word", "quad")


@query("with t as (select l_orderkey page, l_linenumber no, l_comment txt from (select l_orderkey, l_linenumber, concat(l_returnflag, ' ', cast(l_partkey as varchar)) l_comment from lineitem)) select page, no, txt AS line, no = 1 AS header from t where length(txt) >= 4 and not (no > 1 and txt like 'R 1%')")
def ocr_clean_column(spark, sf):
    t = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("no"), F.concat_ws(" ", "l_returnflag", F.col("l_partkey").cast("string")).alias("line"))
    return t.where((F.length("line") >= 4) & ~((F.col("no") > 1) & F.col("line").startswith("R 1"))).withColumn("header", F.col("no") == 1)


@query("select k.doc_id AS scan, concat(w, cast(k.doc_id as varchar)) AS crop, i AS ordinal from documents k, (select unnest(['L', 'R', 'F']) w, unnest([1, 2, 3]) i) x")
def scan_columns(spark, sf):
    crops = F.posexplode(F.array(*[F.concat(F.lit(w), F.col("doc_id")) for w in "LRF"])).alias("p", "crop")
    return table(spark, sf, "documents").select(F.col("doc_id").alias("scan"), crops).select("scan", "crop", (F.col("p") + 1).alias("ordinal"))


@query("select doc_id, n_pages AS pages, 2 AS skipped, n_pages - 2 AS recognised from (select doc_id, doc_id % 9 + 3 n_pages from documents)")
def sidecar_pages(spark, sf):
    """Pages of an OCR sidecar: parts between form feeds; a note of skipped ranges lists pages that weren't recognised."""
    side = F.concat(F.repeat(F.lit("text\f"), (F.col("doc_id") % 9 + 2).cast("int")), F.lit("[OCR skipped on page(s) 1-2]"))
    d = table(spark, sf, "documents").select("doc_id", side.alias("s"))
    ranges = F.transform(F.regexp_extract_all("s", F.lit(r"page\(s\) ([0-9]+-[0-9]+)"), 1), lambda r: F.sequence(F.split(r, "-")[0].cast("int"), F.split(r, "-")[1].cast("int")))
    pages = F.size(F.split("s", "\f")).cast("long")
    return d.select("doc_id", pages.alias("pages"), F.size(F.flatten(ranges)).alias("skipped"), (pages - F.size(F.flatten(ranges))).alias("recognised"))


@query(r"select conv_id, trim(regexp_replace(regexp_replace(string_agg(concat(text, case when turn % 2 = 0 then '-' else '' end), chr(10) order by turn, text), '(\p{L})[-¬]\n(\p{Ll})', '\1\2', 'g'), '\s+', ' ', 'g')) AS joined from conversations group by 1")
def join_lines(spark, sf):
    """A column's lines as one text: turns stand for lines, every second one ends in a hyphen."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.concat("text", F.when(F.col("turn") % 2 == 0, "-").otherwise("")).alias("t"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", "t"))), lambda x: x["t"])
    return c.groupBy("conv_id").agg(T.joined_lines(lines).alias("joined"))


@query(f"select a.chunk_id, b.chunk_id AS neighbour, b.doc_id - a.doc_id AS distance from ({CHUNKS}) a join ({CHUNKS}) b on a.item_key = b.item_key and a.lang = b.lang and b.doc_id between a.doc_id - 40 and a.doc_id + 40 where a.doc_id % 50 = 0")
def context_neighbors(spark, sf):
    from ..operators.retrieval import band_join

    c = chunks(spark, sf).select("item_key", "lang", "doc_id", "chunk_id")
    return band_join(c.where("doc_id % 50 = 0"), c, ["item_key", "lang"], "doc_id", 40, 40, {"chunk_id": "neighbour"}).select("chunk_id", "neighbour", F.col("distance"))
