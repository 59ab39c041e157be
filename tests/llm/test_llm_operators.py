import random

import pytest
from pyspark.sql import functions as F

from lucerna.llm import canonical, leak, linkage, names, pack, residue, scan, split, survivor


# 1 splitting
def test_pieces_stay_within_the_limit_and_cover_the_text():
    rng = random.Random(1)
    for n in (0, 1, 1199, 1200, 1201, 5000, 60_000):
        for alphabet in ("abc. \n", "x", "说。明", "á "):
            text = "".join(rng.choice(alphabet) for _ in range(n))
            cuts = split.pieces(text)
            assert all(0 < e - s <= 1200 or not text for s, e in cuts)
            seen = set()
            for s, e in cuts:
                seen.update(range(s, e))
            assert all(text[i].isspace() for i in range(n) if i not in seen)
            assert all(b[0] > a[0] and a[1] - b[0] <= 200 for a, b in zip(cuts, cuts[1:]))


def test_split_edges(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "y" * 1300, None), (3, "y" * 1300, 7)], "id long, text string, char_start int").withColumn("piece", F.lit(9))
    got = split.split_oversized(df).orderBy("char_start", "piece").collect()
    assert [(r["item_id"], r["piece"], r["char_start"]) for r in got if r["piece"] == 0] == [(3, 0, 0), (3, 0, 7)]
    assert split.split_oversized(df.limit(0)).count() == 0


# 2 canonical text
@pytest.mark.parametrize("a,b", [("Ｔｈｅ", "The"), ("é", "é"), ("а​nd", "and"), ("A B", "A B"), ("ﬁeld", "field"), ("Lуα", "Lyα"), ("µm", "μm"), ("Нα line", "Hα line"), ("K", "K")])
def test_same_looking_text(a, b):
    assert canonical.canonical(a) == canonical.canonical(b)
    assert canonical.canonical(canonical.canonical(a)) == canonical.canonical(a)


@pytest.mark.parametrize("a,b", [("m²", "m2"), ("Café", "Cafe"), ("α", "a"), ("The", "the"), ("a-b", "a–b"), ("рост", "poct")])
def test_visibly_different_text(a, b):
    assert canonical.canonical(a) != canonical.canonical(b)


def test_table_is_free_of_conflicts(spark):
    assert canonical.compile_table() and canonical.compile_look_alikes()
    p = spark.createDataFrame([(1, "а b"), (2, None), (3, ""), (4, "a b")], "id long, title string")
    c = spark.createDataFrame([(7, "a b"), (7, "a b"), (8, None)], "cand_id long, title string")
    assert [tuple(r) for r in canonical.same_looking(p, c, "id", "cand_id").collect()] == [(1, 7)]


# 3 survivors
def test_surviving_rows(spark):
    rows = [(1, "2000A", None, None, None), (2, " 2000a\t", "1204.1", None, "2020-01-01"), (3, "none", "arXiv:1204.1v3", "p/A.pdf", "2021-01-01"), (4, "n/a", "-", ".\\P\\a.pdf", None), (5, "x", None, None, None), (6, None, None, None, None)]
    df = spark.createDataFrame(rows, "id long, bibcode string, arxiv_id string, pdf_relpath string, updated_at string").withColumn("node", F.lit(1))
    assert [tuple(r) for r in survivor.surviving_rows(df).collect()] == [(1, 3)]
    assert survivor.surviving_rows(df.limit(0)).count() == 0


def test_branch_and_bound_is_exhaustive_search():
    import itertools

    rng = random.Random(3)
    for _ in range(60):
        opts = {b: [(rng.choice(["", "x", "y"]), rng.random(), f"{b}{k}") for k in range(3)] for b in "pqr"}
        best = 0.0
        for pick in itertools.product(*[[None, *o] for o in opts.values()]):
            bonds = {p[0] for p in pick if p and p[0]}
            if len(bonds) <= 1:
                best = max(best, sum(p[1] for p in pick if p))
        assert abs(survivor.choose(opts)[0] - best) < 1e-9


# 4 scans
def test_scan_repair(spark):
    clean = [(i, "The slope of the temperature gradient changes when chemical tagging replaces the analysis.", None) for i in range(40)]
    noisy = [(100, "The s1ope of the temper-\nature gradient changcs when\n    534\nchemical tagging replaces the analysis.", None), (101, "", None), (102, None, None)]
    df = spark.createDataFrame(clean + noisy, "id long, text string, chunk_id long")
    got = {r["chunk_id"]: r for r in scan.repair_scans(df, None).collect()}
    assert got[100]["text"] == clean[0][1] and (got[100]["n_joined"], got[100]["n_misread"], got[100]["n_removed"]) == (1, 2, 1)
    assert got[1]["text"] == clean[0][1] and got[101]["text"] == "" and 102 not in got
    assert [r["chunk_id"] for r in scan.scanned(scan.repair_scans(df, None)).collect()] == [100]


def test_copies_do_not_make_a_misread_word_known(spark):
    clean = [(i, f"The slope of the temperature gradient changes when chemical tagging replaces analysis {i}.") for i in range(60)]
    noisy = [(1000 + i, "The slope of the temperature gradient changcs when chemical tagging replaces the analysis.") for i in range(30)]
    df = spark.createDataFrame(clean + noisy, "id long, text string")
    got = {r["chunk_id"]: r["text"] for r in scan.repair_scans(df, None).collect()}
    assert {got[i] for i, _ in noisy} == {noisy[0][1].replace("changcs", "changes")}


def test_structure_is_kept():
    import numpy as np

    counts = scan.Counts([np.zeros(w, np.uint32) for w in (scan.UNI, scan.BI, scan.LINES)])
    text = "3.2 Results\n\nE = a t^2 + b   (3)\n1.0\t2.0\n- one\n- two"
    assert scan.repair(text, {}, counts) == (text, 0, 0, 0)


# 5 linkage
def test_journals_and_levels():
    known = [("JGD", ["JGD", "Journal of Galactic Dynamics", "JGDyn"]), ("CSL", ["CSL", "Cosmic Structure Letters", "CStrL"])]
    for s in ("J. Galact. Dyn.", "J.G.D.", "Jour. of Galactic Dyn.", "JGDYN.", "Journal of Galactic Dynmaics"):
        assert linkage.match_journal(s, known) == "JGD"
    assert linkage.match_journal("", known) == "" and linkage.match_journal("Nature", known) == "nature"


def test_linkage(spark):
    refs = [(i, f"Surname{chr(97 + i)} A.", f"Surname{chr(97 + i)}", str(2000 + i), "JGD", str(100 + 7 * i), str(1000 + 13 * i)) for i in range(20)] + [(99, None, None, None, None, None, None)]
    r = spark.createDataFrame(refs, "ref_id long, authors_text string, first_author string, year string, journal string, volume string, page string")
    c = spark.createDataFrame([(500 + i, [a.split()[0] + ", A."], y, j, v, p, None) for i, a, _, y, j, v, p in refs if a], "cand_id long, authors array<string>, year string, journal string, volume string, page string, bibcode string")
    j = spark.createDataFrame([("JGD", "Journal of Galactic Dynamics", "JGDyn")], "journal string, full_name string, bibstem string")
    assert {(x["ref_id"], x["cand_id"]) for x in linkage.link_records(r, c, j).collect()} == {(i, 500 + i) for i in range(20)}
    assert linkage.link_records(r.limit(0), c, j).count() == 0


def test_an_oversized_block_loses_no_pair(spark, monkeypatch):
    monkeypatch.setattr(linkage, "LARGEST", 0)
    schema = "ref_id long, authors_text string, first_author string, year string, journal string, volume string, page string"
    name = lambda i: "Surname" + chr(97 + i) * 3
    mate = lambda i: "Partner" + chr(122 - i) * 3
    rows = [[i, f"{name(i)}, {mate(i)}", name(i), str(1990 + i), "JGD", str(100 + 7 * i), str(1000 + 13 * i)] for i in range(20)]
    rows[3][6] = None  # page missing
    rows[4][6] = "1502"  # 1052 misprinted
    rows[5][5] = rows[5][6] = None  # co-author only
    rows[6][6], rows[6][2], rows[6][1] = None, "Surnamxggg", f"Surnamxggg, {mate(6)}"  # year and volume
    c = [(500 + i, [f"{name(i)}, A.", f"{mate(i)}, B."], str(1990 + i), "JGD", str(100 + 7 * i), str(1000 + 13 * i), None) for i in range(20)]
    r = spark.createDataFrame([tuple(x) for x in rows], schema)
    c = spark.createDataFrame(c, "cand_id long, authors array<string>, year string, journal string, volume string, page string, bibcode string")
    j = spark.createDataFrame([("JGD", "Journal of Galactic Dynamics", "JGDyn")], "journal string, full_name string, bibstem string")
    assert {(x["ref_id"], x["cand_id"]) for x in linkage.link_records(r, c, j).collect()} == {(i, 500 + i) for i in range(20)}


# 6 names
def test_name_variants(spark):
    spelled = ["Bronemetriss, Daniel P.", "Bronemetriss D. P.", "D. P. Bronemetriss", "Bronmeetriss D. P.", "BRONEMETRISS, Daniel P."]
    other = ["Bronemetriss, Katherine", "Zavejubri, Pavel B.", "Sibro Survey Collaboration", "The Sibro Collaboration", "Ragri, James", "Jim Ragri", "", None, "42"]
    df = spark.createDataFrame([(n, 3 if n == spelled[0] else 1) for n in spelled + other], "name string, n long")
    got = {tuple(r) for r in names.variant_pairs(names.link_names(df)).collect()}
    want = {(a, b) for a in spelled for b in spelled if a < b} | {("Sibro Survey Collaboration", "The Sibro Collaboration"), ("Jim Ragri", "Ragri, James")}
    assert got == want


def test_collaborations_are_verified_by_token_weights(spark):
    one = ["Fokutore Surv. Coll.", "Fokutore Survey Collaboration", "The Fokutore Collaboration"]
    other = ["Zavejubri Survey Collaboration", "Fokutore Tremaviku Survey Collaboration", "Nuvadotil Surv. Coll.", "Nuvadotil Gebrusto Collab.", "Sijamado Surv. Coll."]
    df = spark.createDataFrame([(n, 2) for n in one + other], "name string, n long")
    got = {tuple(r) for r in names.variant_pairs(names.link_names(df)).collect()}
    assert got == {(a, b) for a in one for b in one if a < b}


# 7 packing
def test_packing_is_whole_and_full(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([1, 7, 64, 64, 64, 100, 500, 2048, 2049, 5000, 0])) for i in range(600)] + [(600, None)]
    df = spark.createDataFrame(rows, "doc_id long, tokens long")
    for strategy in ("shortest", "best", "auto"):
        got = pack.fill_containers(df, 2048, strategy=strategy).collect()
        load: dict = {}
        for r in got:
            load[r["container"]] = load.get(r["container"], 0) + r["tokens"]
        assert max(load.values()) <= 2048 and load.pop(0) == 0
        assert sum(load.values()) == sum(n or 0 for _, n in rows)
        assert len(load) <= sum(n or 0 for _, n in rows) / 2048 * 1.05 + 2
        assert all(r["piece"] == 0 for r in got if dict(rows)[r["doc_id"]] and dict(rows)[r["doc_id"]] <= 2048)
    assert pack.fill_containers(df.limit(0), 2048).count() == 0


# 8 leaks
def _brute(machine, code):
    out = {}
    for item, mine in machine.items.items():
        for k in range(len(mine) - leak.RUN + 1):
            for j in range(len(code) - leak.RUN + 1):
                if list(code[j : j + leak.RUN]) == mine[k : k + leak.RUN]:
                    out.setdefault(item, set()).add((j, k))
    return out


def test_wu_manber_finds_what_brute_force_finds():
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(12)]
    for _ in range(30):
        machine = leak.WuManber({i: [rng.choice(vocab) for _ in range(9)] for i in range(4)})
        for n in (0, 3, 4, 5, 60):
            code = machine.encode([rng.choice(vocab + ["zz"]) for _ in range(n)])
            assert {i: set(v) for i, v in machine.find(code).items()} == _brute(machine, code.tolist())


def test_leaks(spark):
    words = [f"word{i}" for i in range(60)]
    item = " ".join(words)
    altered = [w if k % 9 else "other" for k, w in enumerate(words[10:40])]
    docs = [(1, "Start. " + item.upper().replace(" ", ",\n") + " end"), (2, "x " + " ".join(altered) + " y"), (3, " ".join(words[:20])), (4, None), (5, ""), (1, item)]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(1))
    q = spark.createDataFrame([(70, item), (70, item), (71, None), (72, "")], "item_id long, text string")
    assert {(r["item_id"], r["doc_id"]) for r in leak.find_leaks(d, q).collect()} == {(70, 1), (70, 2)}
    assert leak.find_leaks(d, q, block_chars=1).count() == 2
    assert leak.find_leaks(d, q.limit(0)).count() == 0


# 9 residue
def test_residue(spark):
    prose = "The residuals correlate with the colour excess, which rules out a selection effect in eccentric systems. The web viewer needs JavaScript, so we also give a plain table."
    rows = [(i, prose) for i in range(200)] + [(900, "Title: {{title}}"), (901, prose + " Please enable JavaScript to view this page. " + prose), (902, None), (903, ""), (904, "Lorem ipsum dolor sit amet."), (904, "Lorem ipsum dolor sit amet.")]
    got = sorted(r["doc_id"] for r in residue.find_residue(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [900, 901, 904, 904]


def test_copies_of_an_error_page_do_not_count_as_prose(spark):
    rng = random.Random(9)
    vocab = ["".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(3000)]
    prose = [(i, " ".join(rng.choice(vocab) for _ in range(190)) + ".") for i in range(400)]
    page = [(1000 + i, f"Please verify that you are a human to continue. Request id {70000 + i}.") for i in range(200)]
    got = {r["doc_id"] for r in residue.find_residue(spark.createDataFrame(prose + page, "doc_id long, text string")).collect()}
    assert got == {i for i, _ in page}


def test_short_and_often_altered_items_are_found(spark):
    words = [f"term{i}" for i in range(40)]
    altered = " ".join(w if (k + 1) % 4 else "other" for k, w in enumerate(words))
    docs = spark.createDataFrame([(1, "He said: one small step, and left."), (2, f"before {altered} after"), (3, "one step"), (4, "Small")], "doc_id long, text string")
    items = spark.createDataFrame([(10, "One small step"), (11, " ".join(words)), (12, "one step"), (13, "small")], "item_id long, text string")
    got = {(r["item_id"], r["doc_id"]) for r in leak.find_leaks(docs, items).collect()}
    assert got == {(10, 1), (11, 2), (12, 3), (13, 1), (13, 4)}


def test_a_hot_length_is_split(spark, monkeypatch):
    monkeypatch.setattr(pack, "PART", 10)
    df = spark.createDataFrame([(i, 700 if i % 3 else 64) for i in range(400)] + [(1000, 9000)], "doc_id long, tokens long")
    got = pack.fill_containers(df, 2048).toPandas()
    assert got.groupby("container").tokens.sum().max() <= 2048 and got.tokens.sum() == 9000 + sum(700 if i % 3 else 64 for i in range(400))


def test_survivor_ties_and_nulls(spark):
    rows = [(9, "b1", None, None, None), (4, "b1", "1", None, "2020"), (5, "b1", "1", None, "2020"), (6, "b1", None, "x/y.pdf", "2021"), (7, "z", None, None, None), (8, "z", None, None, None)]
    df = spark.createDataFrame(rows, "id long, bibcode string, arxiv_id string, pdf_relpath string, updated_at string")
    assert sorted(map(tuple, survivor.surviving_rows(df).collect())) == [(4, 6), (7, 7)]


def test_counts_of_many_partitions_are_added_in_a_tree(spark, monkeypatch):
    from lucerna.llm import hashed

    monkeypatch.setattr(hashed, "FAN_IN", 2)
    df = spark.createDataFrame([(f"t{i % 7}",) for i in range(300)], "text string").repartition(11)

    def feed(tables, rows):
        for (t,) in rows:
            tables[0][int(t[1:])] += 1

    (got,) = hashed.corpus_counts(df, ["text"], [64], feed)
    assert got.tolist()[:8] == [sum(i % 7 == k for i in range(300)) for k in range(7)] + [0]


def test_residue_is_learned_from_texts_that_are_mostly_residue(spark):
    prose = [(i, f"The residuals of field {i} correlate with the colour excess, which rules out a selection effect in eccentric systems.") for i in range(300)]
    pages = [(1000 + i, "Error 503 Backend fetch failed. Guru Meditation. XID: 77\nQuorlix zamboni frelk wibbled at node.") for i in range(1)] + [(1100 + i, f"403 Forbidden. Access denied. You are not authorized to access this page.\nQuorlix zamboni frelk wibbled at node {i}.") for i in range(20)]
    alone = [(2000, "Quorlix zamboni frelk wibbled at node 5.")]
    got = {r["doc_id"] for r in residue.find_residue(spark.createDataFrame(prose + pages + alone, "doc_id long, text string")).collect()}
    assert got == {i for i, _ in pages + alone}
