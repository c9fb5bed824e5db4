"""Kernels by literal expectations and against brute force."""

import itertools
import random

import pytest

from strandex.functions import text as X
from strandex.operators import clauses as C
from strandex.operators import geometry as G
from strandex.operators import inventory as I
from strandex.operators import metrics as M
from strandex.operators import previews as V
from strandex.operators import sections as S


# Text


@pytest.mark.parametrize("text, want", [("café ação under_score ½ ＡＢＣ", "cafe acao under_score 1 2 abc"), ("con-\ntrato português", "contrato portugues"), ("① ﬁnal ¼", "1 final 1 4"), ("con-\nTrato x- y", "con trato x y"), (None, ""), ("", "")])
def test_canonical(text, want):
    assert X.canonical(text) == want


def test_tokens_have_their_places():
    text = "The con-\n tract, ½ Ünï"
    for t in X.tokenize(text):
        assert t.value in X.canonical(text[t.start : t.start + t.length])
    assert [(t.value, t.start, t.length) for t in X.tokenize(text)][1] == ("contract", 4, 11)


@pytest.mark.parametrize("text, want", [("foo­\n bar", "foobar"), ("foo­\n Bar", "foo\n Bar"), ("a \t\nb​\x07", "a\nb"), ("x\r\ny\rz", "x\ny\nz"), ("  ", ""), (None, "")])
def test_display(spark, text, want):
    assert X.for_display(text) == want
    assert spark.createDataFrame([(text,)], "t string").select(X.display_column(__import__("pyspark.sql.functions", fromlist=["col"]).col("t"))).first()[0] == want


def test_search_forms():
    assert X.for_search("ﬁ  ½ ｘ\n exam-\nple") == "fi 1⁄2 x exam- ple"
    assert X.for_search("exam-\nple Exam-\nPle", True) == "example Exam- Ple"
    assert X.name_key(" straße\tＡ") == "STRASSE A"


@pytest.mark.parametrize("word, want", [("end.", True), ("end", False), ("e.g.", False), ("Fig.", False), ("J.", False), ("12.", False), ("123.", True), ('done.")', True), ("what?", True), ("。", True), ("", False)])
def test_sentence_ends(word, want):
    assert X.ends_sentence(word) is want


def test_mail_bodies():
    assert X.signature_start("Hi\n-- \nAnn", True) == 3 and X.signature_start("--\nHi", True) is None and X.signature_start("Hi\n--\nAnn") is None
    long = "This line is longer than eighty characters, and so it is kept only once in the body text."
    assert X.clean_body(f"{long}\n{long}\nshort\nshort") == f"{long} short short"
    assert X.clean_body("x", boilerplate=True) == ""
    assert X.clean_body("Hi\n\nThis email and any attachments are confidential\nmore\n\nend\n--\nsig", email_body=True) == "Hi end"


def test_compose_keeps_the_budget():
    out = X.compose("body", [("Title", "T"), ("Again", " t "), ("Empty", None), ("Long", "w " * 300)])
    assert out.startswith("body Title: T Long: w w") and sum(map(X.approximate_tokens, out.split("Title")[1:])) <= X.CONTEXT_TOKENS + 8


def test_utf16():
    text = "a😀b"
    assert X.utf16_offset(text, 2) == 3 and X.utf16_slice(text, 3, 1) == "b" and X.utf16_slice(text, 1, 2) == "😀"


# Clauses


def passes(spark, clauses, rows, msm=0):
    F = __import__("pyspark.sql.functions", fromlist=["col"])
    e = C.evaluate(clauses, {"body": F.col("b"), "title": F.col("t")}, msm)
    return [r["id"] for r in spark.createDataFrame(rows, "id int, b string, t string").where(e.matches).orderBy("id").collect()]


def test_clauses(spark):
    rows = [(1, "the red box", "plan"), (2, "red boxes here", None), (3, None, "red"), (4, "box red", "plan b"), (5, "", "")]
    assert passes(spark, [C.Clause("a", "red")], rows) == [1, 2, 3, 4]
    assert passes(spark, [C.Clause("a", "box", match="prefix", fields=("body",))], rows) == [1, 2, 4]
    assert passes(spark, [C.Clause("a", "red box", match="phrase")], rows) == [1]
    assert passes(spark, [C.Clause("a", "red"), C.Clause("n", "plan", "must_not")], rows) == [2, 3]
    should = [C.Clause("a", "red", "should"), C.Clause("b", "plan", "should"), C.Clause("c", "box", "should")]
    assert [passes(spark, should, rows, k) for k in range(4)] == [[1, 2, 3, 4, 5], [1, 2, 3, 4], [1, 4], [1, 4]]


@pytest.mark.parametrize("bad, code", [({"clauses": (C.Clause("a", "x y"),)}, "not_one_term"), ({"clauses": (C.Clause("a", "x"), C.Clause("a", "y"))}, "invalid_clause_id"), ({"clauses": (C.Clause("a", "!"),)}, "empty_clause"), ({"clauses": (C.Clause("a", "x", "must_not"),)}, "no_positive_clause"),
                                       ({"clauses": (C.Clause("a", "x"),), "minimum_should_match": 1}, "invalid_minimum_should_match"), ({"mode": "semantic"}, "no_semantic_query"), ({"clauses": (C.Clause("a", "x"),), "mode": "keyword", "semantic_query": "q"}, "no_effect"), ({"candidate_limit": 0}, "invalid_candidate_limit")])
def test_requests_are_checked(bad, code):
    with pytest.raises(C.RequestError) as e:
        C.SearchRequest(**({"mode": "keyword"} | bad)).validate()
    assert e.value.code == code


# Previews


def test_proximity_against_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        spans = [V.Span(rng.choice("abc"), rng.randrange(100), rng.randrange(1, 8)) for _ in range(rng.randrange(1, 9))]
        ids = sorted({s.clause for s in spans})
        if len(ids) < 2:
            assert V.proximity(spans) == 0
            continue
        ordered = sorted(spans, key=lambda s: (s.start, s.length))
        best = None
        for i, j in itertools.combinations_with_replacement(range(len(ordered)), 2):
            w = ordered[i : j + 1]
            if {s.clause for s in w} == set(ids):
                gap = max(0, max(s.end for s in w) - w[0].start - sum(min(s.length for s in w if s.clause == c) for c in ids))
                best = gap if best is None else min(best, gap)
        assert abs(V.proximity(spans) - 1 / (1 + best / 12)) < 1e-12


def test_anchor_window_against_brute_force():
    rng = random.Random(2)
    terms = {"ab1", "cd2", "efg"}
    for _ in range(80):
        text = " ".join(rng.choice(["ab1", "cd2", "efg", "word", "other"]) for _ in range(rng.randrange(5, 80)))
        got = V.anchor_window(text, terms, 60)
        found = [t for t in X.tokenize(text) if t.value in terms]
        starts = [0, *(max(0, min(t.start - 30, len(text) - 60)) for t in found)]
        count = lambda s: len({t.value for t in found if t.start >= s and t.start + t.length <= s + 60})
        if len(text) <= 60 or not found or max(map(count, starts)) == 0:
            assert got is None
        else:
            assert count(got[0]) == max(map(count, starts)) and got[0] == next(s for s in starts if count(s) == max(map(count, starts)))


def test_excerpts_are_literal_and_keep_the_match():
    rng = random.Random(3)
    clause = [C.Clause("a", "needle")]
    for _ in range(50):
        words = ["needle" if rng.random() < 0.01 else rng.choice(["word", "end.", "Other"]) for _ in range(rng.randrange(1, 600))]
        text = " ".join(words)
        spans = V.body_spans(text, clause)
        start, length = V.excerpt(text, spans)
        assert 0 <= start and length <= 800 and start + length <= len(text)
        if spans:
            assert any(s.start >= start and s.end <= start + length for s in spans)


def test_choosing_previews():
    p = lambda i, offset, start=0, length=100: {"id": i, "section": "s", "offset": offset, "start": start, "length": length, "spans": []}
    assert [x["id"] for x in V.choose_previews([p(1, 0), p(2, 50), p(3, 500)], 2)] == [1, 3]
    assert [x["id"] for x in V.choose_previews([p(1, 0), p(2, 50)], 2)] == [1, 2]


def test_pages_with_diversity():
    assert V.page_with_diversity(list("aaabca"), 3, 1) == [0, 1, 2, 0, 0, 3]
    assert V.page_with_diversity([], 3, 1) == []


def test_clause_evidence_over_passages():
    items = [{"id": "p", "offset": 0, "text": "x" * 10, "ordinal": 0, "spans": [], "fields": []}, {"id": "q", "offset": 8, "text": "y" * 10, "ordinal": 1, "spans": [], "fields": []}]
    assert V.clause_evidence(items, [V.Span("a", 2, 3), V.Span("b", 6, 6)]) == {"a": ["p"], "b": ["p", "q"]}


# Sections and chunks


def test_headers_and_rows():
    assert S.parse_header("Name\tQty\n1\t2").display == "Name | Qty"
    assert S.parse_header("1\t2\nName\tQty") is None
    assert S.parse_header("2019\t2020").display == "2019 | 2020"
    assert S.parse_header("Big table\nName\tQty\na\t1").display == "Name | Qty"
    h = S.parse_header("A1: Name\tB1: Qty", True)
    assert S.linearize("A1: Name\tB1: Qty\nA2: x\tC2: z", h, True) == "Name: x; z."
    assert S.linearize("A1: Name\tB1: Qty", h, True) == "Name; Qty."


def test_sheet_with_two_tables():
    rows = [("A1:B1", "A1: Name\tB1: Qty"), ("A2:B2", "A2: x\tB2: 1"), ("A5", "A5: Second"), ("A6:C6", "A6: City\tB6: Rate\tC6: Sum"), ("A7:C7", "A7: Rome\tB7: 2\tC7: 3")]
    got = [(h.display if h else None, c) for h, c in S.sheet_contexts(rows)]
    assert got == [("Name | Qty", None)] * 2 + [("City | Rate | Sum", "Second")] * 3


def test_chunks_cover_the_text():
    rng = random.Random(4)
    for table in (False, True):
        for _ in range(15):
            rows = [("\t" if table else " ").join("".join(rng.choice("abc") for _ in range(rng.randrange(1, 12))) + rng.choice(["", "", "."]) for _ in range(rng.randrange(1, 12))) for _ in range(rng.randrange(1, 500))]
            text = "\n".join(rows)
            got = S.chunk(text, table)
            reach = 0
            for t, a in got:
                assert text[a : a + len(t)] == t and X.approximate_tokens(t) <= S.MAXIMUM and not text[reach:a].strip()
                reach = max(reach, a + len(t))
            assert not text[reach:].strip()
            if table:
                assert all(a == 0 or text[a - 1] == "\n" for _, a in got)
    assert S.chunk("") == [] and len(S.chunk("x" * 9000)) > 4


def test_passages_of_blocks():
    blocks = [S.Block("Intro", kind="structure", path="document/paragraph[1]", heading="H", heading_path=("H",)), S.Block("More text here.", kind="structure", path="document/paragraph[2]", heading="H", heading_path=("H",)), S.Block("Col\tNum\nx\t1", kind="structure", path="document/table[1]", heading="H", heading_path=("H",))]
    sections, passages = S.passages_of(blocks, "c", "f.docx", "T")
    assert sections[0]["display_text"] == "Intro\nMore text here." and len(passages) == 2
    assert passages[0]["display_text"] == "Intro\nMore text here." and "Col: x; Num: 1." in passages[1]["semantic_text"]
    for p in passages:
        s = next(x for x in sections if x["id"] == p["section_id"])
        assert s["display_text"][p["section_offset"] :].startswith(p["display_text"])
    assert S.passages_of(blocks, "c", "f.docx", "T")[1][0]["id"] == passages[0]["id"] != S.passages_of(blocks, "d", "f.docx", "T")[1][0]["id"]


def test_bullets_apart_from_their_items():
    b = lambda t, x, w: S.Block(t, kind="page", page=1, path="page[1]/block[1]", region=(x, 0.5, w, 0.02))
    assert S.separated_markers([b("•", 0.1, 0.01), b("the item", 0.13, 0.5)]) == {0}
    assert S.separated_markers([b("left", 0.03, 0.06), b("•", 0.1, 0.01), b("the item", 0.13, 0.5)]) == set()


def test_keys_in_frames_and_lists(spark):
    rng = random.Random(5)
    kinds = [rng.choice([1, 1, 2]) for _ in range(40)]
    keys = [rng.choice([None, None, None, "k"]) for _ in kinds]
    want = [b.key for b in S.section_keys([S.Block("t", kind="page", page=p, key=k) for p, k in zip(kinds, keys)])]
    df = spark.createDataFrame([("c", i, f"page:{p}", k) for i, (p, k) in enumerate(zip(kinds, keys))], "c string, o int, b string, k string")
    got = [r["section_key"] for r in S.assign_keys(df, "c", "o", "b", "k").orderBy("o").collect()]
    # an explicit key is kept until the boundary changes; frames number the boundaries that began a section
    assert [g == "k" for g in got] == [w == "k" for w in want]


# Geometry


def test_reading_order_of_columns():
    left = [G.Box(f"l{i}", 0.1, 0.2 + 0.03 * i, 0.35, 0.02) for i in range(6)]
    right = [G.Box(f"r{i}", 0.55, 0.2 + 0.03 * i, 0.35, 0.02) for i in range(6)]
    head = G.Box("head", 0.1, 0.05, 0.8, 0.03)
    mixed = [head, *left, *right]
    random.Random(6).shuffle(mixed)
    assert [b.text for b in G.reading_order(mixed)] == ["head", *(b.text for b in left), *(b.text for b in right)]


def test_union_area_against_a_grid():
    rng = random.Random(7)
    for _ in range(30):
        boxes = [(a, b, a + rng.randrange(1, 5), b + rng.randrange(1, 5)) for a, b in ((rng.randrange(8), rng.randrange(8)) for _ in range(rng.randrange(0, 6)))]
        assert G.union_area(boxes) == len({(x, y) for l, t, r, b in boxes for x in range(l, r) for y in range(t, b)})


@pytest.mark.parametrize("token, bad", [("hello", False), ("e.g.", False), ("don't", False), ("(word)", False), ("U.S.'s", False), ("wor~ld", True), ("a,;b", True), ("wOrLd", False), ("abCDefGHij", True), ("(open", False), ("op(en", True), ("http://x~y", False), ("C++", False)])
def test_garbled(token, bad):
    assert G.is_garbled(token) is bad


def test_quality():
    assert G.text_quality("This is a clean sentence of plain words.") > 0.99
    assert G.text_quality("Th�s �s br�ken") < 0.3 and G.text_quality("") == 0 and G.text_quality("* * * * *") < 0.5


def test_tables_lines_and_paragraphs():
    cells = [G.Box(t, x, 0.1 + 0.03 * r, 0.1, 0.02) for r, row in enumerate([("Item", "Qty"), ("a", "1"), ("b", "2"), ("c", "3")]) for t, x in zip(row, (0.1, 0.4))]
    assert G.aligned_tables(cells)[0].text == "Item\tQty\na\t1\nb\t2\nc\t3"
    lines = [G.Box(f"line {i}", 0.1, 0.1 + 0.025 * i, 0.5, 0.02, 90.0, "Ocr") for i in range(3)] + [G.Box("far", 0.1, 0.4, 0.5, 0.02, 80.0, "Ocr")]
    assert [b.text for b in G.group_paragraphs(lines)] == ["line 0\nline 1\nline 2", "far"]
    assert [b.text for b in G.join_markers([G.Box("2.1", 0.1, 0.1, 0.02, 0.02), G.Box("Head", 0.14, 0.1, 0.3, 0.02)])] == ["2.1 Head"]
    assert G.grid_cells([(0.1, 0.1, 0.5), (0.2, 0.1, 0.5)], [(0.1, 0.1, 0.2), (0.3, 0.1, 0.2), (0.5, 0.1, 0.2)]) == [[(0.1, 0.1, 0.3, 0.2), (0.3, 0.1, 0.5, 0.2)]]


def test_reconciling():
    native = [G.Box("Good native text stays here.", 0.1, 0.1, 0.5, 0.02), G.Box("�~�*|�", 0.1, 0.3, 0.5, 0.02)]
    seen = [G.Box("Good native text stays here.", 0.1, 0.1, 0.5, 0.02, 95.0, "Ocr"), G.Box("The readable line", 0.1, 0.3, 0.5, 0.02, 95.0, "Ocr"), G.Box("Missing line", 0.1, 0.5, 0.5, 0.02, 95.0, "Ocr"), G.Box("unsure", 0.1, 0.7, 0.5, 0.02, 20.0, "Ocr")]
    assert [b.text for b in G.reconcile(native, seen, 90.0)] == ["Good native text stays here.", "The readable line", "Missing line"]
    assert G.needs_recognition(native[:1], False) and not G.needs_recognition([G.Box("plain words of text " * 10, 0, 0, 1, 1)], False)


# Metrics and paging


def test_error_rates_against_recursion():
    from functools import lru_cache

    @lru_cache(None)
    def d(a, b):
        return len(a) + len(b) if not a or not b else min(d(a[1:], b) + 1, d(a, b[1:]) + 1, d(a[1:], b[1:]) + (a[0] != b[0]))

    rng = random.Random(8)
    for _ in range(60):
        a, b = ("".join(rng.choice("ab c") for _ in range(rng.randrange(7))) for _ in "12")
        assert M.edits(a, b) == d(a, b)
    assert M.word_error_rate("a b c", "a x c") == pytest.approx(1 / 3) and M.word_error_rate("", "") == 0
    assert M.indel_similarity("abc", "abd") == pytest.approx(4 / 6) and M.near_match("needle", "a neeble b", 1) and not M.near_match("needle", "a nexxle", 1)
    assert M.anchored("cost 12.5 kg", "12.5") and not M.anchored("cost 112.5", "12.5") and not M.anchored("v 12.55", "12.5")


def test_box_coverage():
    gold, covered, n, hit = M.coverage_of_boxes([(0, 0, 1, 1), (0, 0, 1, 1), (2, 2, 3, 3)], [(0, 0, 1, 0.6)])
    assert (gold, pytest.approx(covered), n, hit) == (2, 0.6, 2, 1)


def test_metrics_frame(spark):
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3), (2, "z", 1), (1, "a", 5)], "q int, i string, rank int")
    judged = spark.createDataFrame([(1, "b", 2), (1, "c", 1), (1, "b", 1), (1, "x", 1), (2, "y", 1), (3, "n", 0)], "q int, i string, gain int")
    got = {r["q"]: r for r in M.ranking_metrics(ranked, judged, "q", "i", 3).collect()}
    assert set(got) == {1, 2} and got[1]["recall"] == pytest.approx(2 / 3) and got[1]["reciprocal_rank"] == 0.5
    assert got[1]["ndcg"] == pytest.approx(M.dcg([0, 2, 1]) / M.dcg([2, 1, 1])) and got[2]["ndcg"] == 0


def test_keyset_pages_see_every_row_once(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice([None, 1, 2, 3]), rng.choice(["x", "y", None])) for i in range(57)]
    df = spark.createDataFrame(rows, "id int, a int, b string")
    for up in (True, False):
        keys = [("a", up), ("b", not up), ("id", True)]
        seen, after = [], None
        while True:
            page = I.keyset_page(df, keys, after, 10).collect()
            seen += [r["id"] for r in page[:10]]
            if len(page) <= 10:
                break
            after = [page[9][c] for c, _ in keys]
        order = sorted(rows, key=lambda r: ((r[1] is not None, r[1] or 0) if up else (r[1] is None, -(r[1] or 0)), (r[2] is None, [-ord(c) for c in r[2] or ""]) if up else (r[2] is not None, r[2] or ""), r[0]))
        assert seen == [r[0] for r in order]


def test_cursors():
    c = I.encode_cursor({"x": 1}, 7, ["a", None, 3])
    assert I.decode_cursor(c, {"x": 1}, 7) == ["a", None, 3]
    for bad in (({"x": 2}, 7), ({"x": 1}, 8)):
        with pytest.raises(C.RequestError):
            I.decode_cursor(c, *bad)
    with pytest.raises(C.RequestError):
        I.decode_cursor("%%%", {}, 1)


def test_over_coverage(spark):
    from strandex.operators import metrics as M

    rows = [("q", 1, [[0.0, 0.0, 1.0, 1.0]], [[0.0, 0.0, 2.0, 1.0], [0.0, 0.0, 2.0, 1.0]]), ("q", 2, None, [[0.0, 0.0, 1.0, 2.0]]), ("q", 9, [[0.0, 0.0, 9.0, 9.0]], [[0.0, 0.0, 9.0, 9.0]]), ("z", 1, [[0.0, 0.0, 1.0, 1.0]], None)]
    df = spark.createDataFrame(rows, "q string, r int, gold array<array<double>>, made array<array<double>>")
    got = {r["q"]: (r["predicted_area"], r["shared_area"], r["precision"]) for r in M.over_coverage(df, ["q"], "gold", "made", "r", 5).collect()}
    assert got == {"q": (4.0, 1.0, 0.25), "z": (0.0, 0.0, None)}


# Keyword ranking


def test_many_queries_shuffle_no_pairs(spark):
    from pyspark.sql import functions as F

    from strandex.operators import ranking as R

    made = random.Random(5)
    texts = {i: [made.choice("abcdefgh") for _ in range(made.randrange(9))] for i in range(60)} | {60: None}
    asked = {q: made.sample("abcdefghz", 3) for q in range(7)}
    docs = spark.createDataFrame([*texts.items(), (None, ["a"])], "id bigint, tokens array<string>").repartition(3)
    terms = spark.createDataFrame([(q, w) for q, ws in asked.items() for w in [*ws, ws[0]]], "query_id bigint, term string")
    rows = [*(t or [] for t in texts.values()), ["a"]]
    average = sum(map(len, rows)) / len(rows)

    def score(ws, t):
        return sum(R.idf(len(rows), sum(w in r for r in rows)) * t.count(w) * 2.2 / (t.count(w) + 1.2 * (0.25 + 0.75 * len(t) / average)) for w in ws)

    for block in (4096, 3):
        found = R.bm25_many(docs, "id", "tokens", terms, 5, 5, block)
        got = {(r["query_id"], r["rank"]): (r["id"], r["score"]) for r in found.collect()}
        want = {}
        for q, ws in asked.items():
            best = sorted((-round(score(ws, t), 5), i) for i, t in texts.items() if t and set(ws) & set(t))[:5]
            want |= {(q, n): (i, -s) for n, (s, i) in enumerate(best, 1)}
        assert got == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan.split("MapInArrow")[0]  # no pair of query and row is made in a frame
    assert R.bm25_many(docs, "id", "tokens", terms.where(F.lit(False)), 5, 5).count() == 0


def test_postings_are_made_where_their_row_is(spark):
    from pyspark.sql import functions as F

    from strandex import store
    from strandex.operators import postings as P
    from strandex.operators import ranking as R

    made = random.Random(6)
    texts = {i: " ".join(made.choice(["a", "b", "c", "dé", ""]) for _ in range(made.randrange(9))) for i in range(40)} | {40: None}
    rows = spark.createDataFrame(list(texts.items()), "id bigint, body string").repartition(3)
    postings, lengths = P.index_rows(rows, "s", "id", {"body": "body"})
    assert "Exchange" not in postings._jdf.queryExecution().executedPlan().toString().replace("Exchange RoundRobin", "").split("MapInArrow")[0]
    want = set()
    for i, t in texts.items():
        words = [w for w in (t or "").split(" ") if w]
        want |= {("s", str(i), "body", w, tuple(k for k, x in enumerate(words) if x == w)) for w in words}
    assert sorted((*r[:4], tuple(r[4])) for r in postings.collect()) == sorted(want)
    laid = store.by_term(store.shaped("postings", postings), 4)
    assert sorted((*r[:4], tuple(r[4])) for r in laid.collect()) == sorted(want)
    assert laid.where(F.col("head") != store.head_column(F.col("term"))).count() == 0
    terms = spark.createDataFrame([(1, "a"), (1, "dé"), (2, "b"), (2, "zz")], "query_id bigint, term string")
    stored = R.bm25_postings(laid.select("id", "term", F.size("positions").alias("tf")), lengths.select("id", "length"), terms, 5, 5)
    scanned = R.bm25_many(rows.select("id", F.filter(F.split("body", " "), lambda w: w != "").alias("tokens")), "id", "tokens", terms, 5, 5)
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, scanned.collect())) and stored.count() == 10


# Trees


def test_ancestors_of_more_rows_than_a_recursion_may_have(spark):
    from strandex.operators import trees

    up = {i: i - 1 for i in range(1, 7)} | {i: 6 for i in range(100, 160)} | {200: None, 201: 300}
    rows = [*((str(i), None if p is None else str(p)) for i, p in up.items()), ("4", "200"), (None, "3")]
    nodes = spark.createDataFrame(rows, "id string, parent string")

    def above(i, steps=1):
        for n, p in rows:
            if n == i and p is not None:
                yield p, steps
                yield from above(p, steps + 1)

    want = sorted((i or "", a, s) for i in {i for i, _ in rows} for a, s in above(i))
    spark.conf.set("spark.sql.cteRecursionRowLimit", "50")
    try:
        got = trees.recursive_ancestors(nodes, "id", "parent").collect()
        some = trees.recursive_ancestors(nodes, "id", "parent", spark.createDataFrame([("101",), ("2",)], "id string")).collect()
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")
    assert sorted((r["id"] or "", r["ancestor"], r["steps"]) for r in got) == want
    assert sorted((r["id"], r["ancestor"], r["steps"]) for r in some) == [w for w in want if w[0] in ("101", "2")]
    with pytest.raises(ValueError, match="cycle"):
        trees.recursive_ancestors(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "a")], "id string, parent string"), "id", "parent")
