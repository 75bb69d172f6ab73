import pytest
from pyspark.sql import functions as F

from lexiloom.functions import text as X
from lexiloom.operators import records as D
from lexiloom.sources import sinks


def test_assembly_names_missing_keys(spark):
    items = spark.createDataFrame([("i1",), ("i1",), ("i2",)], "item_key string")
    children = spark.createDataFrame([("a1", "i1", "attachment"), ("n1", "i1", "note"), ("a2", "i2", "attachment"), ("a3", "gone", "attachment")], "attachment_key string, item_key string, kind string")
    ann = spark.createDataFrame([("a1",), ("a2",), ("a3",)], "attachment_key string")
    got = {k: v.count() for k, v in D.assembled(items, children, ann, ann, items.where("item_key = 'i1'")).items()}
    assert got == {"items": 1, "attachments": 1, "notes": 1, "annotations": 1, "embedded": 1}
    assert D.assembled(items, children, ann, ann)["annotations"].count() == 2
    with pytest.raises(ValueError, match="i9"):
        D.assembled(items, children, ann, ann, spark.createDataFrame([("i9",), ("i1",)], "item_key string"))


def test_page_ranges(spark):
    fields = [("141-53", (141, 153)), ("pp. 7 – 12", (7, 12)), ("12-7", (12, 17)), ("172-141", (None, None)), ("1-2, 5-6", (None, None)), ("9", (None, None)), (None, (None, None)), ("98-102", (98, 102))]
    rows = spark.createDataFrame([(f,) for f, _ in fields], "f string").select(*X.page_range(F.col("f"))).collect()
    assert [tuple(r) for r in rows] == [w for _, w in fields]


def test_cover_score(spark):
    d = spark.createDataFrame([("Stable URL: x. Published by y", 100.0, 150.0), ("word " * 100, 100.0, 150.0), ("", 104.0, 150.0)], "t string, w double, h double")
    assert [r[0] for r in d.select(D.cover_score(F.col("t"), F.col("w"), F.col("h"), F.lit(100.0), F.lit(150.0))).collect()] == [5, 0, 3]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 'say "x", y', None), ("b", "line\nbreak", 2)], "k string, t string, n int")
    sinks.write_csv_file(df, str(tmp_path / "one.csv"))
    raw = (tmp_path / "one.csv").read_bytes()
    assert raw.startswith(b"\xef\xbb\xbfk,t,n\r\n") and b'"say ""x"", y"' in raw
    from lexiloom.sources.library import read_csv

    assert [tuple(r) for r in read_csv(spark, str(tmp_path / "one.csv"), "k string, t string, n int").collect()] == [tuple(r) for r in df.collect()]
    assert read_csv(spark, str(tmp_path / "none.csv"), "k string").count() == 0
    with pytest.raises(ValueError):
        sinks.write_csv_file(df, str(tmp_path / "two.csv"), most=1)
    sinks.write_csv_folder(df, str(tmp_path / "many"))
    assert spark.read.csv(str(tmp_path / "many"), header=True, multiLine=True, escape='"').count() == 2
    plan = sinks.append_new(df.select("k", "n"), spark.createDataFrame([("a", 9), ("c", 3), ("c", 3)], "k string, n int"), "k")
    assert sorted(tuple(r) for r in plan.collect() if r["k"] != "a") == [("b", 2), ("c", 3)] and plan.where("k = 'a'").first()["n"] is None


def test_manifest_and_partial_files(spark, tmp_path):
    manifest = spark.createDataFrame([("a1", "i1", "old")], "attachment_key string, item_key string, args string")
    attachments = spark.createDataFrame([("a1", "attachment", "i1"), ("n1", "note", "i1"), ("a2", "attachment", None)], "attachment_key string, kind string, item_key string")
    items = spark.createDataFrame([("i1",)], "item_key string")
    row = lambda k: spark.createDataFrame([(k, "new")], "attachment_key string, args string")
    assert [tuple(r) for r in sinks.registered(manifest, row("a1"), attachments, items).collect()] == [("a1", "i1", "new")]
    for bad in ("n1", "a2", "zz"):
        with pytest.raises(ValueError):
            sinks.registered(manifest, row(bad), attachments, items)
    out = tmp_path / "out"
    out.mkdir()
    for name in ("k1.pdf", "k1.txt", "a1.pdf"):
        (out / name).write_text("x")
    assert sinks.remove_partial(spark, str(out), "k1", manifest, str(tmp_path / "storage")) == ["k1.pdf", "k1.txt"]
    assert sinks.remove_partial(spark, str(out), "a1", manifest, str(tmp_path / "storage")) == [] and (out / "a1.pdf").exists()
    with pytest.raises(RuntimeError):
        sinks.remove_partial(spark, str(out), "k2", manifest, str(tmp_path))


def test_markdown_of_several_attachments(spark):
    rows = spark.createDataFrame([("i", "A", "", "T", "b", 2, "x", "highlight", "q1\nq2", "", 1), ("i", "A", "", "T", "a", 1, "1", "note", "", "mine", 2), ("i", "A", "", "T", "b", 3, "", "highlight", "q", "c", 3)], "item_key string, author string, year string, title string, attachment_key string, page int, page_label string, kind string, body string, remark string, place int")
    assert sinks.annotation_markdown(rows).first()["markdown"] == "## A. *T*\n\n### Attachment b\n\n- **p. 2 [x]** · highlight\n  > q1 q2\n\n- **p. 3** · highlight\n  > q\n\n  **Comment:** c\n\n### Attachment a\n\n- **p. 1** · note\n  **Comment:** mine\n"


def refused(path, start, limit):
    return 404, [], 0


def test_paged_listing_and_tables(spark, tmp_path):
    from lexiloom.sources import library as L

    spark.dataSource.register(L.PagedItems)
    load = lambda fetch, path: spark.read.format("paged_items").option("fetch", fetch).option("path", path).option("size", 7).load()
    assert load("lexiloom.sources.library:numbered_items", "20").count() == 20 and load("lexiloom.sources.library:numbered_items", "0").count() == 0
    with pytest.raises(Exception, match="fetch must name"):
        load("nothing", "1").count()
    assert L.listing_error(404, "x") == "x was not found" and L.listing_error(500, "x") and L.listing_error(200, "x") is None
    (tmp_path / "a.tsv").write_text("level\tpage\tblock\tpar\tline\tword\tleft\ttop\twidth\theight\tconf\ttext\n4\t1\t1\t1\t1\t0\t0\t0\t9\t9\t-1\t\n5\t1\t1\t1\t1\t2\t50\t10\t9\t9\t90\tsays\n5\t1\t1\t1\t1\t1\t5\t11\t9\t9\t90\t\"he\n")
    assert [r["text"] for r in D.text_lines(L.read_tsv(spark, str(tmp_path / "a.tsv")), ["page"]).collect()] == ['"he says']
    (tmp_path / "audit.csv").write_text("attachment_key,item_key,content_type,exists,path\na1,i1,application/pdf,yes,/x.pdf\na2,i1,application/pdf,no,/y.pdf\na3,i2,text/html,yes,/z\na4,i2,application/pdf,yes,\na5,i3,application/pdf,yes,/w.pdf\n")
    schema = "attachment_key string, item_key string, content_type string, exists string, path string"
    keys = lambda *a, **k: [r[0] for r in L.read_attachments(spark, str(tmp_path / "audit.csv"), schema, *a, **k).collect()]
    assert keys() == ["a1", "a5"] and keys(["i3"]) == ["a5"] and keys(["a1"], limit=1) == ["a1"] and len(keys(limit=1)) == 1
