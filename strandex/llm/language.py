"""Languages of documents and of the passages inside them, by averaged hashed subword embeddings with a linear softmax."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from unicodedata import normalize
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship

#: Names that texts' labels use for languages, besides two-letter codes (fixed values: code, three-letter codes, English and own names).
NAMES = {
    "en": "eng english", "de": "deu ger german deutsch", "fr": "fra fre french français francais", "es": "spa spanish español espanol castellano",
    "pt": "por portuguese português portugues", "it": "ita italian italiano", "nl": "nld dut dutch nederlands", "sv": "swe swedish svenska", "da": "dan danish dansk",
    "nb": "nob nor norwegian norsk no", "fi": "fin finnish suomi", "pl": "pol polish polski", "cs": "ces cze czech čeština", "hu": "hun hungarian magyar",
    "ro": "ron rum romanian română", "ru": "rus russian русский", "uk": "ukr ukrainian українська", "el": "ell gre greek ελληνικά", "tr": "tur turkish türkçe",
    "ca": "cat catalan català", "ja": "jpn japanese 日本語", "zh": "zho chi chinese 中文", "ko": "kor korean 한국어", "ar": "ara arabic العربية",
}
_CODES = {n: code for code, names in NAMES.items() for n in [code, *names.split()]}
#: Labels that name no language (fixed values).
NO_LABEL = {"", "und", "unknown", "??", "?", "xx", "zxx", "mul", "n/a", "na", "none", "null", "-", "other"}

#: Bound of the labelled sample: documents of each label, and sentences of each document.
SAMPLE_DOCUMENTS, SAMPLE_SENTENCES = 300, 6
BUCKETS, DIMENSION, GRAMS = 1 << 15, 12, (3, 4)
#: Passes over the sample, and steps of 64 sentences that are made at least.
EPOCHS, STEPS = 8, 1200
#: The least part of the commonest language's rows that those of another count for.
RARE = 0.05
#: Sentences with less confidence than a threshold get no language. It is the highest that rejects no more than this part of the held-out
#: sentences that are labelled right, between these limits.
LOST, REJECT_LEAST, REJECT_MOST = 0.001, 0.6, 0.8
#: Words a sentence of the sample has at least; sentences with fewer, codes and numbers aside, need SHORT_LETTERS letters and more confidence:
#: a third of the doubt that others may have.
SENTENCE_WORDS = 3
SHORT_LETTERS = 10
#: Letters that parts without the end of a sentence are joined to have, and a whole text has at least.
PART_LETTERS, TEXT_LETTERS = 20, 4
UNDETERMINED = "und"

_CUT = re.compile(r"(?:(?<=[.!?…])|(?<=[.!?…][\"'«»“”‘’›)]))[^\S\n\t]+(?=[\"'«»„“”‚‘‹(¿¡]?[^\W\d_a-zà-öø-ÿ])|[\n\t]+")
_WORD = re.compile(r"[^\W\d_]+")
#: Words of texts with combining accents or invisible characters.
_LOOSE = re.compile("[\u0300-\u036f\u00ad\u200b-\u200d\u2060\ufeff]")
_LOOSE_WORD = re.compile(r"[^\W\d_](?:[^\W\d_]|[\u0300-\u036f\u00ad\u200b-\u200d\u2060\ufeff])*")
_END = re.compile(r"[.!?…][\"'«»“”‘’›)]*\s*\Z")


def label_code(label: str | None) -> str | None:
    """The two-letter code a label stands for, whatever its notation; null for null, blank and placeholder labels, the label itself where it
    names no known language."""
    if label is None:
        return None
    key = label.strip().casefold()
    if key in NO_LABEL:
        return None
    return _CODES.get(key) or _CODES.get(re.split(r"[-_ ]", key)[0]) or key


def label_column(label: Column) -> Column:
    """:func:`label_code` as a column."""
    key = F.lower(F.trim(F.regexp_replace(label, r"^\s+|\s+$", "")))
    names = F.create_map(*[F.lit(x) for pair in _CODES.items() for x in pair])
    return F.when(label.isNotNull() & ~key.isin(*NO_LABEL), F.coalesce(F.element_at(names, key), F.element_at(names, F.get(F.split(key, "[-_ ]"), F.lit(0))), key))


def pieces(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, whole sentence) of the parts of a text between line ends, tabs and sentence ends. A line that stops in the middle of a
    sentence is joined with the next when that goes on in lower case."""
    out, start = [], 0
    n = len(text)
    for m in _CUT.finditer(text):
        end = m.start()
        gap = m[0]
        if end > start and gap[0] == "\n" and gap.count("\n") == 1 and m.end() < n and text[m.end()].islower() and not _END.search(text, max(start, end - 8), end):
            continue
        if end > start:
            out.append((start, end, _END.search(text, max(start, end - 8), end) is not None))
        start = m.end()
    if start < n:
        out.append((start, n, _END.search(text, max(start, n - 8), n) is not None))
    return out


def letters(words: list[str]) -> int:
    """Letters in words; short ones in capitals, as codes have, aside."""
    return sum(len(w) for w in words if len(w) > 3 or not w.isupper())


def grams(word: str) -> list[int]:
    """Buckets of a word: itself and its inner n-grams, with marked ends."""
    marked = f"<{word}>"
    found = [crc32(marked.encode())]
    for n in GRAMS:
        found += [crc32(marked[i : i + n].encode()) for i in range(len(marked) - n + 1)]
    return [g % BUCKETS for g in found]


def plain(word: str) -> str:
    """A word in lower case, composed, without invisible characters."""
    return word.lower() if word.isascii() else normalize("NFKC", re.sub("[\u00ad\u200b-\u200d\u2060\ufeff]", "", word)).lower()


@dataclass
class Model:
    """Scores of each bucket for each language (embeddings times softmax weights), the bias, the temperature, and the confidence below which a
    sentence gets no language."""

    languages: list[str]
    scores: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    reject: float = REJECT_LEAST

    @property
    def short_reject(self) -> float:
        return 1 - (1 - self.reject) / 3


class Labeller:
    """Labels the sentences of texts with a model. Words' scores are kept in a bounded memo."""

    MEMO = 300_000

    def __init__(self, model: Model):
        self.m = model
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.table = np.zeros((1024, len(self.m.languages) + 1), np.float32)

    def _index(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > self.MEMO:
            self._clear()
            known = self.known
        at = [known.get(w, -1) for w in words]
        if -1 in at:
            for w in {w for w, i in zip(words, at) if i < 0}:
                i = known[w] = len(known)
                if i == len(self.table):
                    self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                g = grams(plain(w))
                self.table[i, :-1] = self.m.scores[g].sum(0)
                self.table[i, -1] = len(g)
            at = [known[w] for w in words]
        return np.array(at, np.int64)

    def label(self, texts: list[str], every: bool = False) -> list[list[tuple[int, int, int, float]]]:
        """For each text (start, end, language number or -1, confidence) of its whole sentences.

        With ``every``, of all its parts: those without the end of a sentence are joined until they have enough letters, and a text whose
        parts get no language is scored as a whole."""
        if not self.m.languages:
            return [[] for _ in texts]
        usual_least, short = self.m.reject, self.m.short_reject
        spans: list[tuple[int, int, int, float]] = []
        words: list[str] = []
        begins: list[int] = []

        def add(k: int, a: int, b: int, found: list[str], least: float) -> None:
            begins.append(len(words))
            words.extend(found)
            spans.append((k, a, b, least))

        for k, text in enumerate(texts):
            words_of = (_LOOSE_WORD if not text.isascii() and _LOOSE.search(text) else _WORD).findall
            open_at, open_end, open_words = -1, -1, []
            for a, b, whole in pieces(text):
                if not whole and not every:
                    continue
                found = words_of(text, a, b)
                if whole:
                    usual = sum(1 for w in found if not w.isupper()) >= SENTENCE_WORDS
                    if usual or len(found) > 1 and letters(found) >= SHORT_LETTERS:
                        if open_words and letters(open_words) >= SHORT_LETTERS:
                            add(k, open_at, open_end, open_words, short)
                        open_at, open_words = -1, []
                        add(k, a, b, found, usual_least if usual else short)
                        continue
                    if not every:
                        continue
                if not letters(found):
                    continue
                open_at, open_end, open_words = a if open_at < 0 else open_at, b, open_words + found
                if letters(open_words) >= PART_LETTERS:
                    add(k, open_at, open_end, open_words, usual_least)
                    open_at, open_words = -1, []
            if open_words and letters(open_words) >= SHORT_LETTERS:
                add(k, open_at, open_end, open_words, short)
        out: list[list[tuple[int, int, int, float]]] = [[] for _ in texts]
        for (k, a, b, least), (lang, conf) in zip(spans, self._score(words, begins)):
            out[k].append((a, b, lang if conf >= least else -1, conf))
        if every:
            spans, words, begins = [], [], []
            for k, text in enumerate(texts):
                if all(x[2] < 0 for x in out[k]) and letters(found := _LOOSE_WORD.findall(text)) >= TEXT_LETTERS:
                    a = len(text) - len(text.lstrip())
                    add(k, a, len(text.rstrip()), found, usual_least)
            for (k, a, b, least), (lang, conf) in zip(spans, self._score(words, begins)):
                out[k] = [(a, b, lang if conf >= least else -1, conf)]
        return out

    def _score(self, words: list[str], begins: list[int]) -> list[tuple[int, float]]:
        if not begins:
            return []
        sums = np.add.reduceat(self.table_of(words), begins, axis=0)
        logits = (sums[:, :-1] / sums[:, -1:] + self.m.bias) / self.m.temperature
        logits -= logits.max(1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        return list(zip(best.tolist(), p[np.arange(len(p)), best].tolist()))

    def table_of(self, words: list[str]) -> np.ndarray:
        at = self._index(words)
        return self.table[at]


def _fit(sentences: list[list[list[int]]], labels: np.ndarray, k: int, epochs: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Embeddings, softmax weights and bias by stochastic gradient descent. Rows of a rare language are repeated until they make up RARE of those of
    the commonest: so it is learnt, and still rows of a common language with a wrong label weigh less than those with the right one."""
    rng = np.random.default_rng(seed)
    flat = [np.array([g for w in s for g in w], np.uint16) for s in sentences]  # BUCKETS fit; short integers are sorted by radix
    emb = rng.normal(0, 1.0 / DIMENSION, (BUCKETS, DIMENSION)).astype(np.float32)
    out = np.zeros((DIMENSION, k), np.float32)
    bias = np.zeros(k, np.float32)
    many = np.bincount(labels, minlength=k)
    times = np.maximum(1, -(-RARE * many.max() // np.maximum(many, 1))).astype(np.int64)
    pool = np.repeat(np.arange(len(flat)), times[labels])
    steps, batch, done = epochs * max(1, -(-len(pool) // 64)), 64, 0
    for _ in range(epochs):
        order = rng.permutation(pool)
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            sizes = np.array([len(flat[r]) for r in rows])
            index = np.concatenate([flat[r] for r in rows])
            begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            mean = np.add.reduceat(emb[index], begins, axis=0) / sizes[:, None]
            z = mean @ out + bias
            z -= z.max(1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), labels[rows]] -= 1
            rate = 0.6 * (1 - done / steps)
            done += 1
            back = (p @ out.T) / sizes[:, None]
            out -= rate * (mean.T @ p) / len(rows) * 8
            bias -= rate * p.sum(0) / len(rows)
            change = np.repeat((-rate * back).astype(np.float32), sizes, axis=0)
            by_bucket = np.argsort(index, kind="stable")
            ordered = index[by_bucket]
            first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
            emb[ordered[first]] += np.add.reduceat(change[by_bucket], first, axis=0)
    return emb, out, bias


def train(rows: list[tuple[str, str]], seed: int = 9) -> Model:
    """A model from (sentence, language code) rows whose labels may be wrong in part; languages are learnt however few rows they have.

    Rows are first judged by models of the other half of the rows, twice: those to which these give another language are taken for mislabelled
    and left out. A language whose rows all turn out to be of others is so dropped. A tenth of the rows left is held out from the last model: the
    temperature that gives them the highest likelihood calibrates the confidence, and their confidence sets the threshold of rejection."""
    memo: dict[str, list[int]] = {}
    sentences, codes = [], []
    for text, code in sorted(rows):
        words = [plain(w) for w in _LOOSE_WORD.findall(text)]
        if words:
            for w in words:
                if w not in memo:
                    memo[w] = grams(w)
            sentences.append([memo[w] for w in words])
            codes.append(code)
    languages = sorted(c for c, n in Counter(codes).items() if n > 1)
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32))

    def logits(emb: np.ndarray, out: np.ndarray, bias: np.ndarray, of: list) -> np.ndarray:
        scores = emb @ out
        return np.array([scores[[g for w in s for g in w]].mean(0) for s in of]) + bias

    passes = lambda n, steps: -(-steps * 64 // max(1, n))
    number = {c: i for i, c in enumerate(languages)}
    keep = np.array([i for i, c in enumerate(codes) if c in number])
    y = np.array([number.get(c, -1) for c in codes])
    for turn in range(2 if len(languages) > 1 and len(keep) >= 20 else 0):
        fold = np.random.default_rng(seed + turn).permutation(len(keep)) % 2
        right = np.ones(len(keep), bool)
        for half in (0, 1):
            others, own = keep[fold != half], keep[fold == half]
            z = logits(*_fit([sentences[i] for i in others], y[others], len(languages), max(3, passes(len(others), STEPS // 4)), seed + turn), [sentences[i] for i in own])
            right[fold == half] = z.argmax(1) == y[own]
        # a language with a few rows may have lost them to chance only
        few = np.bincount(y[keep], minlength=len(languages)) < 20
        keep = keep[right | few[y[keep]]]
    left = [k for k in range(len(languages)) if (y[keep] == k).sum() > 1]
    keep = keep[np.isin(y[keep], left)]
    languages, place = [languages[k] for k in left], {k: i for i, k in enumerate(left)}
    y = np.array([place.get(v, -1) for v in y])
    held = keep[np.arange(len(keep)) % 10 == 7] if len(keep) >= 50 else keep
    learn = np.setdiff1d(keep, held) if len(keep) >= 50 else keep
    emb, out, bias = _fit([sentences[i] for i in learn], y[learn], len(languages), max(EPOCHS, passes(len(learn), STEPS)), seed + 2)
    z = logits(emb, out, bias, [sentences[i] for i in held])
    best, temperature = np.inf, 1.0
    for t in (0.1, 0.15, 0.2, 0.3, 0.5, 0.7, 0.85, 1.0, 1.2, 1.5, 2.0, 3.0):
        s = z / t
        s = s - s.max(1, keepdims=True)
        nll = float((np.log(np.exp(s).sum(1)) - s[np.arange(len(held)), y[held]]).mean())
        if nll < best - 1e-4:
            best, temperature = nll, t
    p = np.exp((z - z.max(1, keepdims=True)) / temperature)
    p /= p.sum(1, keepdims=True)
    sure = p.max(1)[p.argmax(1) == y[held]]
    reject = float(np.clip(np.quantile(sure, LOST), REJECT_LEAST, REJECT_MOST)) if len(sure) else REJECT_MOST
    return Model(languages, (emb @ out).astype(np.float32), bias, temperature, reject)


def labelled_sample(df: DataFrame, id_col: str, text_col: str, label_col: str, documents: int = SAMPLE_DOCUMENTS, sentences: int = SAMPLE_SENTENCES) -> list[tuple[str, str]]:
    """At most ``documents`` rows of each labelled language, those of the least hashes of their ids, and ``sentences`` whole sentences of each, evenly
    spread over its text. Labels that come to a two-letter code count, so there are no more than 676 languages.

    The ids are chosen from the columns of ids and labels; texts are then read from the files only that hold a chosen row."""
    try:
        where = F.col("_metadata.file_path")
        df.select(where)
    except AnalysisException:  # no plain table of files
        where = F.lit(None).cast("string")
    code = label_column(F.col(label_col))
    named = df.select(F.col(id_col).alias("_id"), code.alias("_code"), where.alias("_file")).where(F.col("_code").rlike("^[a-z]{2}$") & F.col("_id").isNotNull())
    ranked = named.withColumn("_h", F.xxhash64(F.col("_id").cast("string"), F.lit(91))).withColumn("_n", F.row_number().over(Window.partitionBy("_code").orderBy("_h", "_id")))
    chosen = ranked.where(F.col("_n") <= documents).select("_id", "_code", "_file").collect()
    if not chosen:
        return []
    files = {r["_file"] for r in chosen}
    read = df.where(where.isin(*files)) if None not in files else df
    picked = df.sparkSession.createDataFrame([(r["_id"], r["_code"]) for r in chosen], T.StructType([T.StructField("_id", df.schema[id_col].dataType), T.StructField("_code", T.StringType())]))
    texts = read.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(picked), "_id").select("_text", "_code")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for text, code in part.itertuples(index=False):
                whole = [text[a:b] for a, b, ok in pieces(text) if ok and len(_WORD.findall(text, a, b)) >= SENTENCE_WORDS]
                take = min(sentences, len(whole))
                rows += [(whole[i * len(whole) // take], code) for i in range(take)]
            yield pd.DataFrame(rows, columns=["s", "c"])

    return [(r["s"], r["c"]) for r in texts.mapInPandas(run, "s string, c string").collect()]


DETAIL = T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("sentences", T.LongType()), T.StructField("confidence", T.DoubleType())]))
SEGMENTS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("lang", T.StringType()), T.StructField("confidence", T.DoubleType())]))


def _texts(series: pd.Series, chars: int = 400_000) -> Iterator[list[str]]:
    part, size = [], 0
    for t in series:
        part.append(t or "")
        size += len(part[-1])
        if size >= chars:
            yield part
            part, size = [], 0
    if part:
        yield part


def identify(df: DataFrame, id_col: str, text_col: str, label_col: str, model: Model | None = None, segments: bool = False, every: bool = False) -> DataFrame:
    """(id, label_code, languages) or, with ``segments``, (id, label_code, segments) of every row, duplicates included.

    languages: for each language in which the text has a whole sentence, the number of such sentences and their mean confidence, the most
    frequent first (with ``every``, of all parts, see :meth:`Labeller.label`); ``und`` stands for rejected sentences. segments: runs of sentences of one language with their offsets. Without whole
    sentences (null, blank and code-only texts too) the array is empty. The model is trained on :func:`labelled_sample` unless given; where
    nothing is labelled there are no languages to learn and all arrays are empty. One pass over the ids and labels, one over the files of the
    sample and one over all texts; only the model, whose size is fixed by BUCKETS and the languages, is sent to the executors."""
    ship(df.sparkSession)
    if model is None:
        model = train(labelled_sample(df, id_col, text_col, label_col))
    sent = df.sparkSession.sparkContext.broadcast(model)
    kind = SEGMENTS if segments else DETAIL
    held: dict[int, Labeller] = {}

    @F.pandas_udf(T.StructType([T.StructField("code", T.StringType()), T.StructField("found", kind)]))
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        labeller = held.setdefault(0, Labeller(sent.value))
        names = [*labeller.m.languages, UNDETERMINED]
        codes: dict[str | None, str | None] = {}
        for series, labels in parts:
            found: list[list[dict]] = []
            for texts in _texts(series):
                for sentences in labeller.label(texts, every):
                    if segments:
                        runs: list[dict] = []
                        for a, b, lang, conf in sentences:
                            if runs and runs[-1]["lang"] == names[lang]:
                                runs[-1]["end"] = b
                                runs[-1]["_c"].append(conf)
                            else:
                                runs.append({"start": a, "end": b, "lang": names[lang], "_c": [conf]})
                        for r in runs:
                            c = r.pop("_c")
                            r["confidence"] = sum(c) / len(c)
                        found.append(runs)
                    else:
                        n: dict[int, list[float]] = {}
                        for _, _, lang, conf in sentences:
                            n.setdefault(lang, []).append(conf)
                        found.append([{"lang": names[g], "sentences": len(c), "confidence": sum(c) / len(c)} for g, c in sorted(n.items(), key=lambda x: (-len(x[1]), x[0]))])
            for x in labels.unique():
                codes[x] = label_code(x)
            yield pd.DataFrame({"code": [codes[x] for x in labels], "found": found})

    run = run.asNondeterministic()  # a filter on the result must not make a second reading below it
    return df.select(F.col(id_col), run(F.col(text_col), F.col(label_col)).alias("_x")).select(id_col, F.col("_x.code").alias("label_code"), F.col("_x.found").alias("segments" if segments else "languages"))


def doubtful_labels(identified: DataFrame, id_col: str) -> DataFrame:
    """(id, lang): the languages of the rows whose label is missing, names no language of the text, or whose text has several."""
    known = F.filter("languages", lambda x: x["lang"] != UNDETERMINED)
    langs = F.transform(known, lambda x: x["lang"])
    case = (F.size(langs) > 1) | F.col("label_code").isNull() | ~F.array_contains(langs, F.col("label_code"))
    return identified.where(case).select(id_col, F.explode(langs).alias("lang")).distinct()
