import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandex.llm import bpe_stream, encoding

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def made():
    return bpe_stream.encoder(encoding.vocabulary())


@pytest.fixture(scope="module")
def public():
    t = tokenizers.Tokenizer.from_file(encoding.vocabulary())
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


ODD = ["a" * 3000, " " * 3000 + "x", "ab" * 1500, "1234567890" * 300, "!?" * 900, "\n" * 700, "don't 'll 're' <|endoftext|> x² ½ Ⅷ 一二 ñ _a_ \x1c é́", "'", "\r\n\r\n\tx", "ﬁ 📦📦"]


@pytest.mark.parametrize("text", ODD)
def test_like_public_tokenizer(made, public, text):
    assert made.encode(text) == public(text)


@pytest.mark.parametrize("block", [1, 2, 3, 7, 64, 500])
@pytest.mark.parametrize("held", [3, 40, 1024])
def test_ids_do_not_depend_on_blocks(made, public, block, held, monkeypatch):
    rng = random.Random(block)
    texts = ["".join(rng.choice("ab t\n'reé1²_-　😀the") for _ in range(rng.randint(1, 1500))) for _ in range(8)] + ODD
    monkeypatch.setattr(bpe_stream, "HELD", held)
    for t in texts:
        assert made.encode(t, block) == public(t)
        assert made.count(t, block) == len(public(t))


@pytest.mark.parametrize("alphabet", ["etaoinshrdlu", "a", "ab", "0123456789", "-=", " ", "é中😀"])
def test_run_transducer_holds_little_and_is_exact(made, public, alphabet):
    rng = random.Random(5)
    text = "".join(rng.choice(alphabet) for _ in range(4000))
    run, out = bpe_stream.RunTransducer(made.merges), []
    most = 0
    data = text.encode()
    for i in range(0, len(data), 50):
        out += run.feed(data[i : i + 50])
        most = max(most, len(run.data))
    out += run.finish()
    assert b"".join(out) == data and all(made.merges.adjacent(a, b) for a, b in zip(out, out[1:]))
    if alphabet not in ("é中😀",):
        assert [made.merges.ids[t] for t in out] == public(text)
    assert most <= made.merges.lookahead + made.merges.longest + 50


def test_the_lookahead_alone_is_enough():
    """A small merge list: tokens are emitted by the computed look-ahead, not only where the chains agree, and no text shows it too short."""
    merges = [(b"a", b"b"), (b"b", b"c"), (b"c", b"a"), (b"ab", b"c"), (b"a", b"a"), (b"aa", b"a")]
    ids = {bytes([i]): i for i in range(256)} | {a + b: 256 + k for k, (a, b) in enumerate(merges)}
    m = bpe_stream.MergeList(ids, merges)
    for n in range(1, 9):
        for letters in itertools.product(b"abc", repeat=n):
            data = bytes(letters)
            run = bpe_stream.RunTransducer(m)
            out = [t for i in range(n) for t in run.feed(data[i : i + 1])]
            assert len(run.data) <= m.lookahead + m.longest
            assert tuple(out + run.finish()) == m.merged(data)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=120))
def test_round_trip(text):
    made = bpe_stream.encoder(encoding.vocabulary())
    text = text.encode("utf-8", "ignore").decode()
    assert bpe_stream.Decoder(made.merges).decode(made.encode(text)) == text


def test_decoder_replaces_broken_bytes(made):
    ids = {b: i for b, i in made.merges.ids.items() if len(b) == 1}
    assert bpe_stream.Decoder(made.merges).decode([ids[b"\xe2"], ids[b"\x82"], ids[b"a"], ids[b"\xff"], ids[b"\xc3"]]) == "�a��"


def test_frames(spark, public):
    rows = [(1, "Hello world", 5), (2, None, 6), (3, "", None), (None, "x", 1), (1, "Hello world", 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids bigint")
    got = sorted(((r["doc_id"] or -1), r["ids"]) for r in encoding.encode_texts(df, "doc_id", "text").collect())
    assert got == sorted([(1, public("Hello world"))] * 2 + [(2, []), (3, []), (-1, public("x"))])
    back = {r["doc_id"]: r["text"] for r in encoding.decode_ids(encoding.encode_texts(df, "doc_id", "text"), "doc_id").collect()}
    assert back[1] == "Hello world" and back[2] == back[3] == ""
    counts = encoding.count_tokens(df.select("doc_id", "text"), "text").collect()
    assert sorted(r["n_tokens"] for r in counts) == sorted([len(public("Hello world"))] * 2 + [0, 0, 1])
    assert encoding.encode_texts(df.limit(0), "doc_id", "text").count() == 0
