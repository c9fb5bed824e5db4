"""One form for texts that look the same but are stored with different characters."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep, ship

#: Letters of other scripts that look like a Latin letter (fixed values; each string pairs with the Latin letters above it).
LATIN_FOR_CYRILLIC = "aceijopsxyhdqwlvABCEHIJKMOPSTXYQW"
CYRILLIC = "асеіјорѕхуһԁԛԝӏѵАВСЕНІЈКМОРЅТХУԚԜ"
LATIN_FOR_GREEK = "oavpiuABEZHIKMNOPTYX"
GREEK = "οανριυΑΒΕΖΗΙΚΜΝΟΡΤΥΧ"
#: Signs that look like the hyphen (fixed values).
HYPHENS = "‐‑⁃﹣－۔˗−"
#: Further invisible characters beside those of category Cf: variation selectors, the grapheme joiner, fillers (fixed values).
INVISIBLE = "͏ᅟᅠ឴឵ㅤﾠ" + "".join(map(chr, range(0xFE00, 0xFE10)))

LATIN = "Latin"
_TOKEN = re.compile(r"[^\W\d_](?:[^\W\d_]|[̀-ͯ])*")
_COMMON = re.compile("[a-zA-Z̀-ͯß-öø-ÿÀ-ÖØ-Þ]+")


def _classes() -> dict[str, dict[str, str]]:
    """For each letter with look-alikes, the letter that looks so in each script."""
    out: dict[str, dict[str, str]] = {}
    for latin, other, script in ((LATIN_FOR_CYRILLIC, CYRILLIC, "Cyrillic"), (LATIN_FOR_GREEK, GREEK, "Greek")):
        for a, b in zip(latin, other, strict=True):
            out.setdefault(a, {LATIN: a})[script] = b
    return {c: forms for forms in list(out.values()) for c in forms.values()}


CLASSES = _classes()


class _Fold(dict):
    """Code point → what it is written as, by the character's data: wide, narrow, font and no-break forms, ligatures and other characters that
    stand for several letters as their plain letters, blanks as a space, look-alikes of the hyphen as a hyphen, invisible characters as
    nothing. Filled as characters turn up."""

    def __missing__(self, point: int) -> str | int:
        c = chr(point)
        kind = unicodedata.category(c)
        parts = unicodedata.decomposition(c)
        if kind == "Cf" or c in INVISIBLE:
            new: str | int = ""
        elif c in HYPHENS:
            new = "-"
        elif kind == "Zs":
            new = " "
        elif parts.startswith(("<wide>", "<narrow>", "<font>", "<noBreak>")) or "LIGATURE" in unicodedata.name(c, "") and parts.startswith("<compat>"):
            new = unicodedata.normalize("NFKC", c)
        elif kind[0] in "LN" and parts.startswith("<compat>") and (c == "\u00b5" or all(unicodedata.category(x)[0] in "LM" or x in _JOINED for x in unicodedata.normalize("NFKC", c)) and len(parts.split()) > 2):
            new = unicodedata.normalize("NFKC", c)
        elif c in ROMAN:
            new = unicodedata.normalize("NFKC", c)
        else:
            new = point
        self[point] = new
        return new


#: Signs inside characters that stand for several letters, and numbers that look like one letter (fixed values).
_JOINED = "·ʼʾ"
ROMAN = "ⅠⅤⅩⅬⅭⅮⅯⅰⅴⅹⅼⅽⅾⅿ"
_FOLD = _Fold()


def _plain() -> re.Pattern:
    """Texts of these characters only are in the common form already: Latin letters and punctuation that nothing folds."""
    kept = (c for c in map(chr, [*range(0x80), *range(0xA1, 0x180), *range(0x2013, 0x2027), 0x2030, 0x20AC, 0x2116, 0x2122]) if _FOLD[ord(c)] in (c, ord(c)))
    return re.compile(f"[{''.join(map(re.escape, kept))}]*")


_PLAIN = _plain()


@lru_cache(1 << 16)
def script(letter: str) -> str:
    """The script of a letter, from its character name."""
    if letter in "ªº" or letter.isascii():
        return LATIN
    return unicodedata.name(letter, "?").split(" ")[0].split("-")[0].capitalize()


@lru_cache(1 << 18)
def _scripts(token: str) -> frozenset[str]:
    """Scripts in which every letter of the token has a form: the intersection of the letters' resolved script sets."""
    out: set[str] | None = None
    for c in token:
        if unicodedata.category(c)[0] != "L":
            continue
        own = set(CLASSES[c]) if c in CLASSES else {script(c)}
        out = own if out is None else out & own
        if not out:
            break
    return frozenset(out or ())


def common_form(text: str) -> str:
    """The text in the one form that all texts looking like it have.

    Full-width, narrow and styled forms, ligatures, blanks and hyphens are folded, invisible characters dropped. Each word is then spelt in
    one script: the only one in which all its letters have a form; of several (whole-script look-alikes) the one that most other words of the
    text need, Latin first; where there is none (letters of two scripts that cannot change) each letter with a Latin form is written so.
    Accents are composed. Case, accents, letters, digits, line breaks and the number of blanks are kept."""
    if _PLAIN.fullmatch(text):
        return text
    text = unicodedata.normalize("NFD", text.translate(_FOLD))
    need: Counter[str] = Counter()
    unsure = False
    for m in _TOKEN.finditer(text):
        if not _COMMON.fullmatch(m[0]):
            unsure = True
        found = _scripts(m[0])
        if len(found) == 1:
            need[next(iter(found))] += 1
    if unsure:
        order = sorted(need, key=lambda s: (-need[s], s != LATIN, s))

        def spell(m: re.Match) -> str:
            token = m[0]
            if token.isascii():
                if not need or order[0] == LATIN:
                    return token
            found = _scripts(token)
            if len(found) == 1:
                to = next(iter(found))
            elif found:
                to = next((s for s in order if s in found), LATIN)
            else:
                to = LATIN
            return "".join(CLASSES[c].get(to, c) if c in CLASSES else c for c in token)

        text = _TOKEN.sub(spell, text)
    return unicodedata.normalize("NFC", text)


def unify(df: DataFrame, *cols: str) -> DataFrame:
    """df with the text columns replaced by their common form; nulls stay null, empty texts empty. A map over the rows."""
    ship(df.sparkSession)

    @F.pandas_udf("string")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield s.map(lambda t: None if t is None else common_form(t))

    return df.withColumns({c: run(F.col(c)) for c in cols})


def _digests(*cols: Column) -> Column:
    @F.pandas_udf("array<struct<raw:binary,form:binary>>")
    def run(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        digest = lambda t: blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        for series in parts:
            rows = []
            for texts in zip(*((series,) if isinstance(series, pd.Series) else series)):  # one column comes by itself
                made: dict[str, dict] = {}
                for t in texts:
                    if t is not None and t not in made:
                        form = common_form(t)
                        raw = digest(t)
                        made[t] = {"raw": raw, "form": raw if form is t else digest(form)}
                rows.append([None if t is None else made[t] for t in texts])
            yield pd.Series(rows)

    return run(*cols)


#: Rows of one text are spread over this many parts by the hash of their ids.
SALT = 64


class Looks:
    """The stored forms of the texts of a table that have another stored form looking the same.

    Only 16-byte digests of texts and forms are shuffled, and of a text stored by many rows one row for each of SALT parts; forms stored in one
    way only are dropped first. ``ids`` holds (_at, _form, _raw, _id, _part) of the rows left, ``parts`` the parts of each stored form."""

    def __init__(self, df: DataFrame, id_col: str, cols: list[str]):
        ship(df.sparkSession)
        pos = F.posexplode(_digests(*[F.col(c) for c in cols])).alias("_at", "_x")
        self.names = F.array(*[F.lit(c) for c in cols])
        part = F.pmod(F.xxhash64(F.col("_id").cast("string")), F.lit(SALT)).cast("byte")
        rows = (df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), pos).where(F.col("_x").isNotNull())
                .select("_id", F.col("_at").cast("byte").alias("_at"), F.col("_x.raw").alias("_raw"), F.col("_x.form").alias("_form"), part.alias("_part")))
        rows = keep(rows)
        stored = rows.groupBy("_at", "_form", "_raw", "_part").agg(F.count(F.lit(1)).alias("_n"))
        several = stored.groupBy("_at", "_form").agg(F.min("_raw").alias("_a"), F.max("_raw").alias("_b")).where(F.col("_a") != F.col("_b")).select("_at", "_form")
        self.parts = keep(stored.join(several, ["_at", "_form"], "left_semi").select("_at", "_form", "_raw", "_part"))
        self.ids = keep(rows.join(self.parts, ["_at", "_form", "_raw", "_part"], "left_semi").distinct())

    def pairs(self) -> DataFrame:
        """(field_name, id_a, id_b): pairs of different ids, the smaller first, whose texts differ but have one common form.

        Stored forms are paired, then their parts, and the ids of either side join the pairs of parts; so copies of one text are never compared with
        each other, and a text that many rows store is spread on both sides."""
        raws = self.parts.select("_at", "_form", "_raw").distinct()
        pairs = raws.withColumnRenamed("_raw", "_raw_a").join(raws.withColumnRenamed("_raw", "_raw_b"), ["_at", "_form"]).where(F.col("_raw_a") < F.col("_raw_b")).drop("_form")
        part = lambda x: self.parts.select("_at", F.col("_raw").alias(f"_raw_{x}"), F.col("_part").alias(f"_part_{x}"))
        cells = keep(pairs.join(part("a"), ["_at", "_raw_a"]).join(part("b"), ["_at", "_raw_b"]))
        side = lambda x: cells.join(self.ids.select("_at", F.col("_raw").alias(f"_raw_{x}"), F.col("_part").alias(f"_part_{x}"), F.col("_id").alias(f"_{x}")), ["_at", f"_raw_{x}", f"_part_{x}"])
        both = side("a").join(side("b"), ["_at", "_raw_a", "_raw_b", "_part_a", "_part_b"]).where(F.col("_a") != F.col("_b"))
        return both.select(self.names[F.col("_at").cast("int")].alias("field_name"), F.least("_a", "_b").alias("id_a"), F.greatest("_a", "_b").alias("id_b")).distinct()

    def classes(self) -> DataFrame:
        """(field_name, id, class_id, links): one row for each id and field with links, its class by the least id in it, and the number of rows (id
        and text) of the class whose text differs from its own. As long as the rows, where :meth:`pairs` grows with their square."""
        one = self.ids.groupBy("_at", "_form", "_raw", "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_least"))
        text = one.groupBy("_at", "_form", "_raw").agg(F.sum("_n").alias("_n"), F.min("_least").alias("_least"))
        form = text.groupBy("_at", "_form").agg(F.sum("_n").alias("_all"), F.min("_least").alias("class_id"))
        of_part = self.parts.join(text.select("_at", "_form", "_raw", "_n"), ["_at", "_form", "_raw"]).join(form, ["_at", "_form"])
        got = self.ids.join(of_part, ["_at", "_form", "_raw", "_part"])
        return got.groupBy(self.names[F.col("_at").cast("int")].alias("field_name"), F.col("_id").alias("id"), "class_id").agg(F.sum(F.col("_all") - F.col("_n")).alias("links"))


def same_looking_pairs(df: DataFrame, id_col: str, cols: list[str]) -> DataFrame:
    """(field_name, id_a, id_b): pairs of different ids, the smaller first, whose texts differ but have one common form; see :class:`Looks`.

    The result holds every pair once. Null texts and null ids pair with nothing; repeated rows count once; an id never pairs with itself."""
    return Looks(df, id_col, cols).pairs()


def same_looking_classes(df: DataFrame, id_col: str, cols: list[str]) -> DataFrame:
    """(field_name, id, class_id, links) of the ids that :func:`same_looking_pairs` pairs; nulls and repeated rows as there. An id with several texts
    counts once for each, and is linked with itself."""
    return Looks(df, id_col, cols).classes()
