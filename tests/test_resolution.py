import gzip
import io
import json
import tarfile

from pyspark.sql import functions as F

from lucerna.functions import clean, documents, identifiers, references
from lucerna.functions.chunk import chunk_spans
from lucerna.operators import ingest, resolve, retrieval, topics
from lucerna.sources import formats
from lucerna.sources.providers import TableProvider

PAPERS = "id long, arxiv_id string, bibcode string, title string, abstract string, authors_json string, published string, source string, pdf_relpath string, created_at timestamp, updated_at timestamp"


def _papers(spark, *rows):
    full = [(i, ax, bib, title, abstract, json.dumps(names), year, "x", None, None, None) for i, ax, bib, title, abstract, names, year in rows]
    return spark.createDataFrame(full, PAPERS)


def test_soft_marks_end_in_the_later_half():
    text = "a" * 1049 + ". " + "b" * 800
    assert chunk_spans(text)[0] == (0, 1051)
    assert all(not ("x" * 10 + " " * 400 + "y" * 900)[s:e].isspace() for s, e in chunk_spans("x" * 10 + " " * 400 + "y" * 900, 200, 0))


def test_masthead_titles():
    text = "MNRAS 000, 1–12 (2024)\nPreprint 3 May 2024\n\nA search for variable stars with the WFST\nin the northern sky\n\nJ. Smith,1 A. B. Doe2 and C. Roe1\n\nAbstract\nWe search."
    assert documents.masthead_title(text) == "A search for variable stars with the WFST in the northern sky"
    assert documents.masthead_title("Smith et al. (2020) Abstract starts here and continues") is None
    assert documents.title_candidate("Smith et al. (2020) Abstract starts here and continues") is None
    assert documents.title_candidate("Dark Matter Halos In Cosmological Simulations\n\nrest") == "Dark Matter Halos In Cosmological Simulations"


def test_document_identifiers(spark):
    rows = [(1, "Dark Matter Halos In Cosmological Simulations", "10.1234/test doi stuff arXiv:1801.00001"), (2, "MNRAS 1\n\nThe slow decline of old stars\n\nA. One, B. Two\n\nAbstract", "10.9999/other arXiv:1234.56789"), (3, None, None)]
    df = spark.createDataFrame(rows, "id long, clean string, raw string").select("id", documents.document_identifiers(F.col("clean"), F.col("raw")).alias("x")).select("id", "x.*")
    got = {r["id"]: (r["doi"], r["arxiv"], r["title"]) for r in df.collect()}
    assert got[1] == ("10.1234/test", "1801.00001", "Dark Matter Halos In Cosmological Simulations")
    assert got[2] == (None, None, "The slow decline of old stars") and got[3] == (None, None, None)


def test_catalog_lines_and_search(spark):
    p = _papers(spark, (1, "2001.00001v2", "2020ApJ...900....1S", "Dust in discs", "about dust", ["Smith, J."], "2020-01-01"), (2, None, "2019MNRAS.480....2D", "Gas flows", "about gas", ["Doe, A."], "2019-05-05"), (3, None, None, "Other", None, ["Doe, B."], "2018-01-01"))
    lines = spark.createDataFrame([(1, "2020ApJ...900....1S"), (2, "arXiv:2001.00001"), (3, "Doe A., 2019, MNRAS, 480, 2"), (4, "10.1/none"), (5, "nothing at all")], "line_id long, line string")
    got = {r["line_id"]: (r["bibcode"], r["note"]) for r in resolve.parse_lines(lines, p).collect()}
    assert got[1] == ("2020ApJ...900....1S", "database") and got[2] == ("2020ApJ...900....1S", "database")
    assert got[3] == ("2019MNRAS.480....2D", "library_author_year") and got[4][1] == got[5][1] == "unresolved"
    q = lines.select(F.col("line_id").alias("query_id"), F.col("line").alias("q")).unionByName(spark.createDataFrame([(6, "dust discs")], "query_id long, q string"))
    found = {(r["query_id"], r["id"], r["tier"]) for r in resolve.local_search(q, p).collect()}
    assert {(1, 1, 1), (2, 1, 2), (3, 2, 4), (6, 1, 6)} == found


def test_match_prefers_the_doi_and_the_journal(spark):
    docs = [{"bibcode": b, "year": y, "doi": [doi], "identifier": ["arXiv:1234.5678"], "title": [t]} for b, y, doi, t in (("2024arXiv241108991U", "2024", "10.1/b", "Same title here"), ("2025A&A...693A..69A", "2025", "10.1/a", "Same title here"))]
    d = spark.createDataFrame([(1, json.dumps({"response": {"docs": docs}})), (2, json.dumps({"response": {"docs": docs}})), (3, "{}")], "asked_id long, a string").select("asked_id", F.explode(formats.ads_docs(F.col("a"))).alias("doc"))
    asked = spark.createDataFrame([(1, "10.1/B", None, None), (2, None, None, "Same title here"), (3, None, None, "x")], "asked_id long, doi string, arxiv string, title string")
    assert {tuple(r) for r in ingest.choose_match(asked, d).collect()} == {(1, "2024arXiv241108991U", "doi"), (2, "2025A&A...693A..69A", "title")}


def test_ingest_and_sync(spark):
    p = _papers(spark, (1, None, "2019MNRAS.480....2D", "Gas flows", "about gas", ["Doe, A."], "2019-05-05"))
    doc = {"bibcode": "2020ApJ...900....1S", "year": "2020", "doi": ["10.1234/test"], "title": ["Dark Matter Halos In Cosmological Simulations"], "author": ["Smith, J."]}
    files = spark.createDataFrame([("a.pdf", "Dark Matter Halos In Cosmological Simulations", "10.1234/test"), ("b.pdf", "no", None)], "path string, clean string, raw string")
    after = ingest.ingest_documents(files, p, TableProvider({"10.1234/test": json.dumps({"response": {"docs": [doc]}})}), F.lit("2026-01-01").cast("timestamp")).collect()
    assert {(r["bibcode"], r["pdf_relpath"]) for r in after} == {("2019MNRAS.480....2D", None), ("2020ApJ...900....1S", "pdfs/2020ApJ...900....1S.pdf")}
    e = spark.createDataFrame([], "from_paper_id long, ref_bibcode string")
    assert sorted(map(tuple, ingest.sync_references(p, e, TableProvider({"2019MNRAS.480....2D": '["a", " b ", "a", ""]'})).collect())) == [(1, "a"), (1, "b")]


def test_index_skips_what_is_indexed(spark):
    c = spark.createDataFrame([(5, 1, 0)], "id long, paper_id long, chunk_ord int")
    t = spark.createDataFrame([(1, "old text"), (2, "new text"), (3, None), (4, "  ")], "paper_id long, text string")
    rows = ingest.index_papers(t, c).collect()
    assert [(r["id"], r["paper_id"], r["text"], len(r["embedding"])) for r in rows] == [(6, 2, "new text", 8)]


def test_archives_and_main_file(spark):
    buf = io.BytesIO()
    with tarfile.open(fileobj=buf, mode="w:gz") as tar:
        for name, body in (("x/ms.tex", rb"\documentclass{a}" + b" " * 9000), ("x/a.tex", b"short"), ("fig.pdf", b"%PDF-1")):
            info = tarfile.TarInfo(name)
            info.size = len(body)
            tar.addfile(info, io.BytesIO(body))
    df = spark.createDataFrame([(1, buf.getvalue()), (2, gzip.compress(b"only one")), (3, b"%PDF-1.5 x"), (4, None)], "id long, data binary")
    files = ingest.archive_files(df, "id", "data")
    assert sorted((r["id"], r["path"]) for r in files.collect()) == [(1, "x/a.tex"), (1, "x/ms.tex"), (2, "main.tex")]
    assert {(r["id"], r["path"]) for r in clean.main_tex(files, "id").collect()} == {(1, "x/ms.tex"), (2, "main.tex")}


def test_classification_and_noise(spark):
    rows = [("We use the method of Smith 2020.", "METHOD", False), ("This is consistent with Doe.", "RESULT", False), ("Stars are bright.", "BACKGROUND", False), ("Fig. 3 shows", "BACKGROUND", True), ("1 2 3 4 5 a", "BACKGROUND", True), ("ABSTRACT OF", "BACKGROUND", True)]
    df = spark.createDataFrame(rows, "t string, c string, n boolean")
    for r in df.select("*", references.context_class(F.col("t")).alias("got"), references.is_noise(F.col("t")).alias("noise")).collect():
        assert (r["got"], r["noise"]) == (r["c"], r["n"])
    cats = references.reference_category(spark.createDataFrame([("a", "we use it"), ("a", "consistent with it"), ("b", "we use it")], "w string, t string"), "w", "t", spark.createDataFrame([("a",), ("b",), ("c",)], "w string"))
    assert {r["w"]: r["category"] for r in cats.collect()} == {"a": "RESULT", "b": "METHOD", "c": "UNCITED"}


def test_bibtex_and_logs(spark):
    text = "@article{k1,\n title = {A {B} C},\n year = \"2020\",\n doi = {10.1234/X.},\n file = {a:dir/One.pdf:application/pdf}\n}\n@book{k2,\n title={T},\n eprint={2001.00001v3},\n file={:one.PDF:pdf}\n}"
    e = formats.read_bibtex(spark.createDataFrame([(text,)], "t string"), "t")
    got = {r["key"]: (r["title"], r["year"], r["doi"], r["arxiv"]) for r in e.collect()}
    assert got == {"k1": ("A {B} C", "2020", "10.1234/x", None), "k2": ("T", None, None, "2001.00001")}
    f = formats.failed_files(spark.createDataFrame([("FAIL sub/One.pdf",), ("ok x.pdf",), ("FAIL: two.pdf",)], "l string"), "l")
    assert {tuple(r) for r in formats.retry_plan(f, e).collect()} == {("sub/One.pdf", "k2", True), ("two.pdf", None, False)}


def test_line_scores_and_narrowing(spark):
    df = spark.createDataFrame([(1, 1, "Smith J., 2020, ApJ, 1, 2"), (1, 2, "Doe A., 2019, AJ, 3, 4"), (1, 3, "Roe B., 1999, AJ, 5, 6")], "p long, n long, line string")
    s = df.withColumn("score", documents.line_score(F.col("line"), F.array(F.lit("Smith|2020")), F.lit("as smith et al. 2020 and doe showed")))
    assert [r["score"] for r in s.orderBy("n").collect()] == [30, 2, 0]
    assert [(r["n"], r["pos"]) for r in resolve.narrowed(s, "p", "n", "score", above=2, most=2, must=1).orderBy("pos").collect()] == [(1, 1), (2, 2)]
    assert resolve.narrowed(s, "p", "n", "score", above=10).count() == 3


def test_topics(spark):
    assert topics.expansions(" t ") == ["t", "t methodology", "t results observational implications"]
    assert topics.expansions("t", ["T", "u "]) == ["t", "u"] and topics.expansions("") == []
    c = spark.createDataFrame([(1, 7, 0, "the dust"), (2, 7, 1, "dust and gas"), (3, 8, 0, "ice"), (4, 8, 1, None)], "id long, paper_id long, chunk_ord int, text string")
    p = _papers(spark, (7, None, "b7", "T7", "", [], "2020"))
    hits = topics.with_metadata(topics.gather(c, ["dust", "dust gas"]), c, p)
    assert sorted((r["id"], r["query_no"], r["dropped"]) for r in hits.collect()) == [(1, 0, 1), (2, 0, 1)]
    e = spark.createDataFrame([(7, "r1", "Ref one", True)], "from_paper_id long, ref_bibcode string, title string, has_local_pdf boolean")
    block = topics.report(hits, e).orderBy("tag").first()
    assert block["tag"] == "S1" and "### S1 — retrieved excerpt" in block["block"] and "R1: r1 [in library] — Ref one" in block["block"]
    assert "T7" in topics.dossier(hits).first()["block"] and topics.dossier(hits, 1).count() == 1


def test_journals_and_answers(spark):
    df = spark.createDataFrame([("Mon. Not. R. Astron. Soc.",), ("A&A",), (" Some  Journal ",), ("",), (None,)], "j string")
    assert [r["x"] for r in df.select(identifiers.canonical_journal(F.col("j")).alias("x")).collect()] == ["MNRAS", "A&A", "Some Journal", None, None]
    assert df.select(identifiers.journal_stem(F.lit("Astron. Astrophys. Rev.")).alias("x")).first()["x"] == "A&ARv"
    a = spark.createDataFrame([('<think>{x</think> ```json\n{"a": 1}\n```',), ("none",), ('{"a": ',)], "t string")
    assert [r["x"] for r in a.select(identifiers.json_object(F.col("t")).alias("x")).collect()] == ['{"a": 1}', None, None]


def test_a_hot_paper_keeps_its_bundles(spark):
    df = spark.createDataFrame([(1, k, "x" * 30) for k in range(500)] + [(2, 0, None), (3, 0, "y" * 500)], "p long, o int, t string")
    got = {(r["p"], r["o"]): r["bundle"] for r in retrieval.pack_bundles(df, "p", "o", "t", 100).collect()}
    assert [got[1, k] for k in range(7)] == [0, 0, 0, 1, 1, 1, 2] and got[2, 0] == 0 and got[3, 0] == 0


def test_services(spark, tmp_path):
    from lucerna import services

    _papers(spark, (1, None, "2020ApJ...900....1S", "Dust in discs", "about dust", ["Smith, J."], "2020-01-01")).write.parquet(f"{tmp_path}/papers.parquet")
    lib = services.Library(spark, str(tmp_path))
    assert lib.library_stats().first()["papers"] == 1 and len(services.operations()) >= 17
    assert "@article{2020ApJ...900....1S" in lib.library_bib_export("# c\n2020ApJ...900....1S\n").first()["entry"]


def test_the_registry_needs_no_session():
    import subprocess
    import sys

    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], capture_output=True, text=True, cwd=__file__.rsplit("/tests/", 1)[0])
    assert out.returncode == 0, out.stderr[-500:]
