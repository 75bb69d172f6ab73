import json
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from lexiloom.operators import chunking as C
from lexiloom.operators import formats as X
from lexiloom.operators import retrieval as R
from lexiloom.operators.index import KeywordIndex
from lexiloom.operators.serve import Library, capped
from lexiloom.sources import tei


def words(n, seed=0):
    r = random.Random(seed)
    return " ".join(r.choice(["alpha", "beta.", "gamma", "delta;", "epsilon"]) for _ in range(n))


@pytest.mark.parametrize("n", [0, 1, 449, 450, 451, 2000])
def test_chunks_cover_and_stay_in_budget(n):
    text = words(n, n)
    parts = C.split(text)
    assert all(C.count_words(p) <= C.BUDGET for p in parts)
    flat = " ".join(" ".join(p.split()) for p in parts)
    assert set(text.split()) <= set(flat.split())
    if n <= 450:
        assert parts == ([text] if text else [])
    kept = parts[0].split() if parts else []
    for p in parts[1:]:
        new = p.split()
        k = next(k for k in range(len(new), -1, -1) if kept[len(kept) - k :] == new[:k])
        kept += new[k:]
    assert kept == text.split()


def test_sentence_without_stops_is_cut_by_words():
    parts = C.split(" ".join(f"w{i}" for i in range(1300)))
    assert len(parts) > 2 and all(C.count_words(p) <= C.BUDGET for p in parts)


def test_overlap():
    a, b = "x" * 50 + "the common passage of both texts", "the common passage of both texts goes on"
    assert C.overlap_len(a, b) == len("the common passage of both texts")
    assert C.overlap_len("abc", "xyz") == 0 and C.overlap_len("abc", "") == 0


def test_pages():
    page = "## p. {} (#{}) ####\n{}\n"
    good = "common words stand here again and again on every page of this file " * 5
    text = "".join(page.format(n, i, good) for i, n in enumerate((10, 11, 11, 12), 1)) + page.format(13, 5, "short") + page.format(14, 6, " ".join(f"zq{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(90)))
    sections, report = X.pages(text)
    assert [s.printed for s in sections] == ["10", "11", "12"]
    assert [r["why"] for r in report] == ["repeated label", "too little text", "gibberish"]
    columns, _ = X.pages("## col. 5 (#2) ####\n" + good + "\n## col. 5, notes (#2) ####\n" + good)
    assert [(s.location, s.printed) for s in columns] == [("col. 5", ""), ("col. 5, notes", "")]
    kept, _ = X.pages(X.NO_OCR_FIRST_LINE + "\n" + page.format(1, 1, " ".join(f"q{chr(97 + i % 26)}{chr(97 + i // 26)}z" for i in range(90))))
    assert len(kept) == 1


def test_verse():
    lines = "\n".join(f"[{i}{'a' if i == 12 else ''}] " + words(20, i) for i in range(1, 60))
    text = f"Author, Title\n{X.HEADER_END}\n## Act I\nHECUBA\n{lines}\n### Scene 2\n[60] end\n"
    assert X.detect(text) == "verse"
    out = X.verse(text)
    assert out[0].location.startswith("Act I, vv. 1-") and out[-1].location == "Act I, Scene 2, vv. 60-60"
    assert out[1].text.startswith("HECUBA\n[")


def test_chronicle():
    text = "Prologue text here\n" + "\n".join(f"DE REBUS GESTIS {chr(65 + i) * 2} - Anno Domini {1200 + i} text of\n/*\nmore [\nten\n] years" for i in range(10)) + "\nAnno Domini 1190 back"
    assert X.detect(text) == "chronicle"
    sections, back = X.chronicle(text)
    assert sections[0].location == "prologus" and sections[1].location == "a. 1200, De rebus gestis aa"
    assert back and back[0].endswith("1209 -> 1190")
    assert "[ten] years" in sections[1].text


def test_folio_and_plain():
    out = X.folios("before [foglio I, recto] one [foglio I, verso] two")
    assert [(s.location, s.text) for s in out] == [("", "before"), ("fol. I recto", "one"), ("fol. I verso", "two")]
    assert X.detect("just text") == "plain"


def test_paragraphs():
    long = " ".join(f"Phrase {i} finit ici." for i in range(200))
    text = "\n".join([X.PARAGRAPHS_FIRST_LINE, '%%CHAPTER id=7 part=I label="Chapitre premier" kind=body', "# Titre[^7-1]", "## Section", "[¶1] Premier[^7-2] texte.", "suite du premier.", "Le consul", f"[¶2] {long}", "* * *", "[¶4] Fin[^7-9].", "---", "[^7-1]: note une", "[^7-2]: note deux", "    et sa suite", "[^7-3]: jamais", '%%CHAPTER id=8 label=B kind=bibliography', "Un livre."])
    sections, problems = X.paragraphs(text)
    assert X.detect(text) == "paragraphs"
    body = [s for s in sections if s.extra["chunk_kind"] == "body"]
    assert body[0].location == "Chapitre premier, ¶1" and body[0].text == "Section\nPremier texte.\nsuite du premier."
    assert all(C.count_words(s.text) <= C.BUDGET for s in sections)
    notes = [s for s in sections if s.extra["chunk_kind"] == "notes"]
    assert notes[0].text == "Note 1: note une\nNote 2: note deux et sa suite" and notes[-1].extra["para_start"] == 0
    assert problems["7"] == ["2->4", "undefined 9", "uncalled 3"]
    assert sections[-1].extra["chunk_kind"] == "bibliography"
    assert any("Le consul" in s.text and s.extra["para_start"] == 2 for s in body)


def test_tei():
    raw = '<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><body><div2 n="1"><head>1</head><p>Lead.<pb n="3"/>First wo<pb n="6"/>rd text12 ends,here.</p></div2></body></text></TEI>'
    text = tei.prose(raw)
    assert text.startswith(X.NO_OCR_FIRST_LINE + "\n## p. 3–5 (#1) ####\n") and "word" in text and "## p. 6 (#2) ####" in text and "text ends, here." in text
    repaired = tei.prose(raw.replace("Lead.", "Straße8 egisset, 269 tamen b9 finis.Novum caput [§ 4]"))
    assert "Straße egisset, tamen b finis. Novum caput [§ 4]" in repaired
    play = '<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><titleStmt><title>T</title></titleStmt></teiHeader><text><body><div type="act" n="1"><sp who="#a"><milestone unit="line" n="1"/><l>one</l><l>two</l><milestone unit="line" n="3"/><l part="I">thr</l><l part="F">ee</l></sp></div></body></text></TEI>'
    assert "## Act I\na\n[1] one\n[2] two\n[3] thr\n[3] ee" in tei.drama(play)
    with pytest.raises(ValueError):
        tei.drama(play.replace('n="3"', 'n="5"'))


ROWS = ["Café crème", "CAFE\u0301 NOIR à Łódź", "Ἀθῆναι ταχύς", "naïveté coöperate ﬁne", "one two three four", "Écerinis of the town", "a one b c d two", "n’est pas", "straße und strasse", "two one", "prefixed words", "one two one two three", ""]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    return KeywordIndex.build(spark.createDataFrame(list(enumerate(ROWS)), "doc_id int, text string"), str(tmp_path_factory.mktemp("index") / "one"), buckets=4)


@pytest.mark.parametrize("q", ["one two", '"one two"', "one NOT three", "one OR prefixed", "one NOT two three", "pre*", "NEAR(one two, 1)", "NEAR(one two, 4)", "^two", "one + two", "(one OR town) AND two", '""', "two AND one", "cafe", "CAFÉ", '"cafe creme"', "lodz", "łodz", "naivete", "coop*", "caf* NOT creme", "fine", "ﬁne"])
def test_keyword_language_against_fts5(index, q):
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(text, tokenize='unicode61 remove_diacritics 2')")
    con.executemany("insert into t(rowid, text) values (?, ?)", list(enumerate(ROWS)))
    want = sorted(r[0] for r in con.execute("select rowid from t where t match ?", [q]))
    assert sorted(r[0] for r in R.matches(R.parse(q), index).collect()) == want


@pytest.mark.parametrize("q", ["Vat. Lat. 2962", "(one OR town) two", '"open', "(one", "one AND", "a-b", "NOT one", ""])
def test_broken_queries_fall_back_to_words(index, q):
    with pytest.raises(R.QuerySyntaxError):
        R.parse(q)
    found, _, note = R.keyword_search(q, index)
    found.collect()
    assert note


def test_bm25_against_fts5(spark, tmp_path):
    docs = [words(30 + i, i) for i in range(12)] + ["alpha only", "rare", "", None]
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(text)")
    con.executemany("insert into t(rowid, text) values (?, ?)", list(enumerate(docs)))
    want = {r[0]: -r[1] for r in con.execute("select rowid, bm25(t) from t where t match 'alpha OR rare'")}
    index = KeywordIndex.build(spark.createDataFrame(list(enumerate(docs)), "doc_id int, text string"), str(tmp_path / "index"), buckets=3)
    got = {r["id"]: r["score"] for r in index.bm25(["alpha", "rare"]).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    plan = index.of(["alpha"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters" in plan
    assert KeywordIndex.open(spark, str(tmp_path / "index")).rows == len(docs)


def test_terms_of_queries():
    assert R.query_terms("Che cosa è nel Café?") == ["cosa", "cafe"]
    assert R.query_terms("the of") == ["the", "of"] and R.query_terms("") == []


@pytest.fixture(scope="module")
def library(spark, tmp_path_factory):
    page = "word{} of the page goes on here, "
    rows = [(f"pdf:a1:c{k}", "i1", "a1", "pdf_text", 1 + k // 2, f"[Rossi 1990 · T]\n{page.format(k)}" + ("x" * 20 + f" end {k}" if k % 2 else ""), "", k) for k in range(8)]
    rows += [("txt:c1", "i2", "a2", "text_file", 0, "first verses", "", 1), ("txt:c2", "i2", "a2", "text_file", 0, "second verses", "", 2), ("meta:i1", "i1", "", "metadata", 0, "Rossi record", "", 0)]
    rows += [(f"ann:{k:03d}", "i1", "a1", "highlight", 3, f"Highlighted: passage {k}" + ("\nMy comment: mine" if k % 2 else ""), "Method; Città" if k % 3 == 0 else "", 0) for k in range(60)]
    rows += [("note:n1:c1", "i1", "", "child_note", 0, "my note", "", 0)]
    chunks = spark.createDataFrame(rows, "chunk_id string, item_key string, attachment_key string, source_type string, pdf_page int, text string, annotation_tags string, chunk_seq int").withColumn("yr", F.when(F.col("item_key") == "i1", "1990").otherwise("")).withColumn("lang", F.lit("Italian"))
    items = spark.createDataFrame([("i1", "Rossi, Niccolò", "La città: una storia di molte parole che non finisce mai più", "1990"), ("i2", "Bianchi, A.", "Versi", "1800")], "item_key string, authors string, title string, yr string")
    index = KeywordIndex.build(chunks, str(tmp_path_factory.mktemp("index") / "chunks"), "chunk_id", buckets=2)
    vectors = chunks.select("chunk_id", F.array(F.when(F.col("source_type") == "pdf_text", 1.0).otherwise(0.0), F.when(F.col("source_type") == "pdf_text", 0.0).otherwise(1.0)).alias("embedding"))
    return Library(chunks, items, index, vectors, lambda q: [1.0, 0.0])


def test_search_modes(library):
    both = json.loads(library.search("word3", n=3))
    assert both["hits"]["semantic"] == 50 and both["results"][0]["chunk_id"] == "pdf:a1:c3" and "keyword #1" in both["results"][0]["match"]
    top = both["results"][0]
    assert top["citation"] == "Rossi 1990, La città: una storia di molte parole che non finisce…, PDF p. 2" and top["voice"] == "author" and top["text"].startswith("word3")
    plain = json.loads(library.search("word3", mode="keyword", item_keys="i1", languages="it", year_from=1980))
    assert [r["chunk_id"] for r in plain["results"]] == ["pdf:a1:c3"] and plain["filters"]["languages"] == "it"
    assert json.loads(library.search("verses", mode="keyword", year_from=1700))["note"].startswith("No matching chunks")
    broken = json.loads(library.search("word3 (", mode="keyword"))
    assert broken["results"] and "syntax error" in broken["note"]
    assert [r["source_type"] for r in json.loads(library.search("x", mode="semantic", n=99, tags=["CITTÀ"]))["results"]] == ["highlight"] * 20
    for bad in ({"mode": "both"}, {"source_types": ["book"]}):
        with pytest.raises(ValueError):
            library.search("x", **bad)


def test_context(library):
    pages = json.loads(library.get_context("pdf:a1:c3", before=1, after=99))["pages"]
    assert [p["pdf_page"] for p in pages] == [1, 2, 3, 4] and [p["is_hit_page"] for p in pages] == [False, True, False, False]
    assert pages[1]["text"].count("word2") == 1 and "word3" in pages[1]["text"]
    near = json.loads(library.get_context("txt:c1"))["neighboring_chunks"]
    assert [(r["chunk_id"], r["is_hit"]) for r in near] == [("txt:c1", True), ("txt:c2", False)]
    assert [r["chunk_id"] for r in json.loads(library.get_context("meta:i1"))["chunks"]] == ["meta:i1"]
    assert [r["chunk_id"] for r in json.loads(library.get_context("note:n1:c1"))["neighboring_chunks"]] == ["note:n1:c1"]
    with pytest.raises(ValueError):
        library.get_context("nothing")


def test_item_record_and_lists(library):
    item = json.loads(library.get_item("i1", offset=10))
    assert item["my_annotations_and_notes_total"] == 61 and len(item["annotations_and_notes"]) == 51 and "next_offset" not in item
    pdf = next(a for a in item["attachments"] if a["attachment_key"] == "a1")
    assert pdf["pdf_pages_with_text"] == 4 and pdf["indexed_chunks"] == {"highlight": 60, "pdf_text": 8}
    some = json.loads(library.list_annotations(tag="method", has_comment=True, limit=5, offset=2))
    assert some["total_matching"] == 10 and len(some["annotations"]) == 5 and some["next_offset"] == 7
    assert json.loads(library.list_annotations(has_comment=False))["total_matching"] == 30
    assert [i["item_key"] for i in json.loads(library.find_items("niccolo citt"))["items"]] == ["i1"]
    assert json.loads(library.find_items("nobody"))["note"]
    with pytest.raises(ValueError):
        library.find_items(" ?")


def test_capped():
    rows = [{"text": "t" * 400, "k": k} for k in range(200)]
    text = capped({"results": rows}, "results", 25_000)
    shown = json.loads(text)
    assert len(text) <= 25_000 and 50 <= len(shown["results"]) < 62 and shown["truncated"].startswith(f"{200 - len(shown['results'])} more")
    one = json.loads(capped({"results": [{"text": "t" * 40_000}]}, "results", 25_000))
    assert len(one["results"]) == 1 and one["results"][0]["text"].endswith(" […]")
    assert capped({"results": []}, "results") == json.dumps({"results": []}, indent=1)


def brute_tail(units, count, overlap):
    kept = []
    while len(kept) < len(units) and sum(n for _, n in units[len(units) - len(kept) - 1 :]) <= overlap:
        kept = units[len(units) - len(kept) - 1 :]
    return kept


@pytest.mark.parametrize("seed", range(6))
def test_packing_of_units(seed):
    """Chunks against a plain fold over the units."""
    r = random.Random(seed)
    parts = [(" ".join(f"{k}-{j}" for j in range(n)), n) for k, n in enumerate(r.choice([1, 5, 20, 59, 60, 61, 150, 400, 450]) for _ in range(60))]
    want, open_ = [], []
    for u in parts:
        if open_ and sum(n for _, n in open_) + u[1] > C.BUDGET:
            want.append("\n\n".join(t for t, _ in open_))
            open_ = brute_tail(open_, C.count_words, C.OVERLAP) or [(" ".join(open_[-1][0].split()[-60:]), 60)]
            if sum(n for _, n in open_) + u[1] > C.BUDGET:
                open_ = []
        open_.append(u)
    want.append("\n\n".join(t for t, _ in open_))
    assert C.packed(parts) == want


def test_overlap_by_trying_all():
    r = random.Random(0)
    for _ in range(300):
        a, b = ("".join(r.choice("ab") for _ in range(r.randint(0, 40))) for _ in range(2))
        k = next(k for k in range(min(len(a), len(b)), -1, -1) if a.endswith(b[:k]))
        assert C.overlap_len(a, b, probe=1) == k


def test_french_sentences_and_captions():
    from lexiloom.functions.python_text import sentence_ends, shortened_label

    cut = lambda t, inside=False: [s.strip() for a, b in zip([0, *sentence_ends(t, inside)], [*sentence_ends(t, inside), len(t)]) if (s := t[a:b])]
    assert cut("Voir cf. Bortolami et C. G. Mor. Puis t. II. Le roi dit: «Non. Jamais.» Il part.") == ["Voir cf. Bortolami et C. G. Mor.", "Puis t. II. Le roi dit: «Non. Jamais.»", "Il part."]
    assert len(cut("Il dit «Non. Jamais. Rien» enfin", True)) == 3
    assert X.figure_title("Image 3.jpg — La place — (à suivre) Note") == "La place"
    assert X._plain(r"a \*b\* *c* snake_case_x [^7-2]") == "a *b* c snake_case_x"
    long = shortened_label("Chapitre premier, où l'on voit beaucoup de choses diverses et variées encore", "¶3–5")
    assert len(long) <= 70 and long.endswith("…, ¶3–5")
    assert X.detect("\n".join(f"DE REBUS GESTIS {chr(65 + i) * 2} - text" for i in range(10))) == "chronicle"


def test_formats_as_table(spark):
    docs = spark.createDataFrame([(1, "plain text here"), (2, None), (3, "[foglio I] " + words(900))], "doc_id int, text string")
    out = X.chunk_texts(docs).toPandas()
    assert set(out.format) == {"plain", "folio"} and out.error.isna().all()
    assert docs.select(X.detected("text")).collect()[2][0] == "folio"


def test_md_plain_takes_a_documents_signs_as_its_sql_does(spark, tmp_path):
    import duckdb

    from lexiloom.plans.registry import ORACLE_SQL, QUERIES

    texts = ["a *b* c", "a\\*b*", "\\**x\\\\*y", "c:\\_d\\\\e\\", "see [^12-3] and [^a_b]", "[*^1] [**^x]", "[\\*^1]", "", " \n\t ", "***", None, " a\n\nb ", "\\"]
    rows = [(i, t, lang) for i, (t, lang) in enumerate((t, lang) for t in texts for lang in ("en", "", None, "*\\_ x"))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(f"select doc_id, plain from ({ORACLE_SQL['md_plain']}) order by doc_id").fetchall()
    assert [tuple(r) for r in QUERIES["md_plain"](spark, str(tmp_path)).orderBy("doc_id").collect()] == want


def test_index_is_built_by_the_tasks_that_read_the_rows(spark, tmp_path):
    """A term of every row lies in one sorted file of each task, whatever the shuffle partitions; the statistics are those of all rows."""
    texts = [*(f"the Zoë w{i} w{i % 7} the" for i in range(1200)), "", None, "..."]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(6)
    index = KeywordIndex.build(rows, str(tmp_path / "index"), buckets=3)
    assert (index.rows, index.mean_length) == (1203, 6000 / 1203)
    where = index.of(["the"]).groupBy(F.input_file_name()).agg(F.count("*").alias("n"), F.sum("tf").alias("tf")).collect()
    assert len(where) == 6 and sum(r["n"] for r in where) == 1200 and sum(r["tf"] for r in where) == 2400
    assert [r[0] for r in index.of(["w5", "zoe", "none"]).where("id = 5").orderBy("term").select("positions").collect()] == [[2, 3], [1]]
    for f in index.postings.select(F.input_file_name()).distinct().collect():
        terms = [r[0] for r in spark.read.parquet(f[0]).select("term").collect()]
        assert terms == sorted(terms)


class Rows:
    """Stands for a DataFrame: keeps the function that maps its batches."""

    def __init__(self, schema):
        self.schema = schema

    def select(self, *_):
        return self

    def mapInArrow(self, run, schema):
        return run


@pytest.mark.parametrize("chunked", [C.chunk_documents, X.chunk_texts])
def test_a_worker_holds_objects_for_a_few_texts_only(spark, chunked):
    import tracemalloc

    import pyarrow as pa

    texts = [None, "", *(words(600, i) for i in range(20))]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6600)), pa.array(texts * 300)], ["doc_id", "text"])
    assert batch.nbytes > 20_000_000
    run = chunked(Rows(spark.createDataFrame([], "doc_id long, text string").schema))
    want = list(next(run(iter([batch.slice(0, 22)]))).to_pylist())
    tracemalloc.start()
    n = 0
    for part in run(iter([batch])):
        n += part.num_rows
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 300 * len(want) and peak < 12_000_000


def test_functions_of_single_values_keep_order_and_nulls(spark):
    import pyarrow as pa

    from lexiloom.functions import python_text as P
    from lexiloom.functions.batches import BYTES, ROWS, slices

    texts = ["x" * (i % 7) * 1000 for i in range(3000)] + ["y" * 3_000_000, None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["t"])
    parts = list(slices(batch))
    assert [t for p in parts for t in p.column(0).to_pylist()] == texts
    assert all(p.num_rows == 1 or p.num_rows <= ROWS and p.nbytes <= BYTES for p in parts)
    pages = [None, "", "<nav>n</nav><p>a<p>b"] * 700
    d = spark.createDataFrame([(i, h, ["one two three four five", None, h]) for i, h in enumerate(pages)], "i int, h string, parts array<string>").coalesce(1)
    got = d.select(P.html_text("h", main_only=False), P.stopword_language("h"), R.stitched_all("parts"), C.overlaps(F.lit("ab"), F.lit("b")), P.french_sentences("h")).collect()
    assert [r[0] for r in got] == [P._html(h, False) for h in pages] and {r[1] for r in got} == {""}
    assert [r[2] for r in got] == [R.joined_parts([x for x in ("one two three four five", h) if x is not None]) for h in pages]
    assert {r[3] for r in got} == {1} and [r[4] for r in got[:2]] == [None, []]


def test_an_items_citation_does_not_depend_on_the_order_of_its_chunks(spark, library):
    """Years differ by chunk here: the first chunk by id is cited."""
    from dataclasses import replace

    c = library.chunks.where("chunk_id = 'ann:000'")
    two = [c.withColumns({"chunk_id": F.lit(i), "yr": F.lit(y)}) for i, y in (("a1", "1501"), ("a2", "1502"))]
    for chunks in (two[0].union(two[1]), two[1].union(two[0])):
        assert " 1501" in json.loads(replace(library, chunks=chunks.coalesce(1)).get_item("i1"))["citation"]
