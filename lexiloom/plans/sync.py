"""Queries of incremental sync: documents at two simulated versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sync as S
from ..operators.index import shared_root
from .register import query, table

_NOW = "select concat('text:', cast(doc_id as varchar)) source_id, concat(cast(n_chars as varchar), case when doc_id % 7 = 0 then 'x' else '' end) content_fp, concat(lang, case when doc_id % 5 = 0 then 'x' else '' end) meta_fp from documents where doc_id % 11 <> 0"
_OLD = "select concat('text:', cast(doc_id as varchar)) source_id, cast(n_chars as varchar) content_fp, lang meta_fp from documents where doc_id % 13 <> 0"


def _versions(spark, sf):
    d = table(spark, sf, "documents")
    sid = F.concat(F.lit("text:"), "doc_id").alias("source_id")
    now = d.where("doc_id % 11 <> 0").select(sid, F.concat("n_chars", F.when(F.col("doc_id") % 7 == 0, "x").otherwise("")).alias("content_fp"), F.concat("lang", F.when(F.col("doc_id") % 5 == 0, "x").otherwise("")).alias("meta_fp"))
    return now, d.where("doc_id % 13 <> 0").select(sid, F.col("n_chars").cast("string").alias("content_fp"), F.col("lang").alias("meta_fp"))


@query(f"select coalesce(n.source_id, o.source_id) AS source_id, case when n.source_id is null then 'gone' when o.source_id is null then 'new' when n.content_fp <> o.content_fp then 'changed' when n.meta_fp <> o.meta_fp then 'meta_only' else 'unchanged' end AS class from ({_NOW}) n full join ({_OLD}) o using (source_id)")
def sync_diff(spark, sf):
    return S.diff(*_versions(spark, sf))


@query(f"select n.source_id, n.content_fp from ({_NOW}) n left join ({_OLD}) o using (source_id) where o.source_id is null or n.content_fp <> o.content_fp union all select o.source_id, o.content_fp from ({_OLD}) o left join ({_NOW}) n using (source_id) where n.source_id is null or n.content_fp = o.content_fp")
def sync_replace(spark, sf):
    now, old = _versions(spark, sf)
    work = S.diff(now, old).where(F.col("class").isin(S.NEW, S.CHANGED))
    fresh = now.join(work, "source_id", "left_semi").select("source_id", "content_fp")
    return S.replaced(old.select("source_id", "content_fp"), fresh, work)


@query(f"select o.source_id, o.content_fp, coalesce(n.meta_fp, o.meta_fp) AS meta_fp from ({_OLD}) o left join (select n.* from ({_NOW}) n join ({_OLD}) p using (source_id) where n.content_fp = p.content_fp and n.meta_fp <> p.meta_fp) n using (source_id)")
def sync_meta_update(spark, sf):
    now, old = _versions(spark, sf)
    work = S.diff(now, old).where(F.col("class") == S.META)
    return S.meta_updated(old, now.join(work, "source_id", "left_semi"), "source_id", ["meta_fp"])


@query(f"select source_id from ({_OLD}) where source_id in (select source_id from ({_NOW}))")
def sync_delete(spark, sf):
    now, old = _versions(spark, sf)
    return old.join(S.diff(now, old).where(F.col("class") == S.GONE), "source_id", "left_anti").select("source_id")


def _synced(spark, sf, *versions, failing=lambda w: F.lit(False)):
    """A fresh store after syncing the versions one after another; chunks of a source are its id's last digit plus one."""
    store = S.Snapshots(spark, shared_root(spark, "sync"), buckets=4)

    def build(work):
        n = F.right("source_id", F.lit(1)).cast("int") % 2 + 1
        rows = work.withColumn("seq", F.explode(F.sequence(F.lit(1), n)))
        return rows.select("source_id", "seq", F.concat("source_id", F.lit(" "), "content_fp", F.lit(" of "), "meta_fp").alias("chunk"), F.col("meta_fp").alias("language"), F.when(failing(work), "unreadable").alias("error"))

    counts = [S.sync(store, v, build) for v in versions]
    return store, counts


@query(f"select n.source_id, seq, case when o.content_fp = n.content_fp then concat(n.source_id, ' ', n.content_fp, ' of ', o.meta_fp) else concat(n.source_id, ' ', n.content_fp, ' of ', n.meta_fp) end AS chunk, n.meta_fp AS language from ({_NOW}) n left join ({_OLD}) o using (source_id), range(1, 3) r(seq) where seq <= cast(right(n.source_id, 1) as int) % 2 + 1")
def sync_twice(spark, sf):
    """The store after the old version and then the new one: changed texts are built again, changed metadata alone leaves texts as they were, gone sources go."""
    now, old = _versions(spark, sf)
    store, _ = _synced(spark, sf, old, now)
    return store.read("chunks").select("source_id", F.col("seq").cast("long").alias("seq"), "chunk", "language")


@query(f"select source_id, false AS recorded from ({_NOW}) n where right(source_id, 1) = '3' union all select source_id, true from ({_NOW}) n where right(source_id, 1) <> '3'")
def sync_retry(spark, sf):
    """Sources that can't be read aren't recorded, so the next run sees them as new again."""
    now, _ = _versions(spark, sf)
    store, _ = _synced(spark, sf, now, failing=lambda w: F.right("source_id", F.lit(1)) == "3")
    again = S.diff(now, store.read("known"))
    return again.select("source_id", (F.col("class") == S.SAME).alias("recorded"))
