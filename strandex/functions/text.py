"""Text functions: display and search forms, the canonical token stream, and what rests on them.

Column versions stay in the JVM wherever Spark's functions can say it; compatibility normalisation and offsets need Python and run in Arrow
batches. Index, clause evaluation and previews use the one tokenizer of this module, so their tokens agree."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words whose final stop ends no sentence (fixed values).
ABBREVIATIONS = frozenset((
    "al", "approx", "art", "ca", "cf", "co", "corp", "dept", "dr", "dra", "eq", "eqs", "est", "etc", "fig",
    "figs", "inc", "jr", "ltd", "mr", "mrs", "ms", "no", "nos", "nr", "núm", "pág", "pp", "prof", "ref",
    "sec", "sr", "sra", "st", "vol", "vs",
))
#: Openings of legal disclaimers in mails (fixed values).
DISCLAIMERS = (
    "this email and any attachments are confidential",
    "this message and any attachments are confidential",
    "esta mensagem e seus anexos são confidenciais",
    "este e-mail e seus anexos são confidenciais",
)
#: Tokens of the semantic context, characters of each of its values, and length from which a repeated line is dropped.
CONTEXT_TOKENS, CONTEXT_CHARS, REPEATED_LINE = 64, 200, 80

_LETTER = r"([^\W\d_]|[̀-ͯ])"
_SOFT_WRAP = re.compile(_LETTER + r"­[ \t]*(?:\r\n|[\r\n ])[ \t]*(?=[^\W\d_])")
_CELL_WRAP = re.compile(_LETTER + r"­ *  *(?=[^\W\d_])")
_HARD_WRAP = re.compile(_LETTER + r"[-‐][ \t]*[\n ][ \t]*(?=[^\W\d_])")
_TOKEN = re.compile(r"(?:\w|[̀-ͯ҃-҉֑-ׇؐ-ًؚ-ٰٟऀ-ःऺ-ॏ⃐-⃰])+")
_GAP = re.compile(r"[-‐­][ \t]*(?:\r\n|\r|\n| )[ \t]*")
_SPACE = re.compile(r"\s+")


def _join_wraps(pattern: re.Pattern, text: str) -> str:
    """Removes the wraps that a pattern finds before a lower-case letter."""
    out, at = [], 0
    for m in pattern.finditer(text):
        if unicodedata.category(text[m.end()]) == "Ll":
            out += [text[at : m.end(1)]]
            at = m.end()
    return "".join(out) + text[at:] if out else text


def for_display(text: str | None, table: bool = False) -> str:
    """Text for reading: words wrapped at a soft hyphen joined, control and format characters dropped, line ends as \\n, no blanks at line ends.
    In tables tabs and edges are kept, for they mark empty cells."""
    if text is None or not text.strip():
        return ""
    if "\u00ad" in text:
        text = _join_wraps(_CELL_WRAP if table else _SOFT_WRAP, text)
    unseen = [c for c in set(text) if c not in "\n\r\t" and unicodedata.category(c) in ("Cc", "Cf")]
    if unseen:
        text = text.translate(dict.fromkeys(map(ord, unseen)))
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    return text if table else re.sub(r"[ \t\f\v]+\n", "\n", text).strip()


def for_search(text: str | None, dehyphenate: bool = False) -> str:
    """Text for comparing: the display form, compatibility-composed, with single blanks; visible line-end hyphens joined if asked."""
    shown = for_display(text)
    if dehyphenate and ("-" in shown or "\u2010" in shown) and ("\n" in shown or "\u2028" in shown):
        shown = _join_wraps(_HARD_WRAP, shown)
    return _SPACE.sub(" ", unicodedata.normalize("NFKC", shown)).strip()


def name_key(text: str | None) -> str:
    """Key under which names are equal whatever their case, width and blanks."""
    return for_search(text).upper()


def normalize(text: str | None) -> str:
    """Compatibility form without marks, in lower case."""
    if not text:
        return ""
    if text.isascii():
        return text.lower()
    open_form = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", text))
    return unicodedata.normalize("NFC", "".join(c.lower() for c in open_form if unicodedata.category(c)[0] != "M"))


class Token(NamedTuple):
    value: str
    start: int
    length: int


def tokenize(text: str | None, dehyphenate: bool = True) -> list[Token]:
    """Canonical tokens with the place of their source in the text. A run whose normal form holds separators gives several tokens of one place;
    a word cut by a hyphen at a line end and going on in lower case is one token over both lines."""
    out: list[Token] = []
    for m in _TOKEN.finditer(text or ""):
        raw = m[0]
        parts = [raw.lower()] if raw.isascii() else [p[0] for p in _TOKEN.finditer(normalize(raw))]
        if not parts:
            continue
        if dehyphenate and len(parts) == 1 and out and raw[0].islower():
            last = out[-1]
            end = last.start + last.length
            before = unicodedata.category(text[end - 1])[0]
            if before in "LM" and _GAP.fullmatch(text, end, m.start()):
                out[-1] = Token(last.value + parts[0], last.start, m.end() - last.start)
                continue
        out += [Token(p, m.start(), m.end() - m.start()) for p in parts]
    return out


def tokens(text: str | None) -> list[str]:
    return [t.value for t in tokenize(text)]


def canonical(text: str | None, dehyphenate: bool = True) -> str:
    """The tokens of a text, joined by blanks: what the index holds."""
    return " ".join(t.value for t in tokenize(text, dehyphenate))


def any_of(text: str | None, limit: int = 64) -> str:
    """A disjunction of a text's first tokens, for free-text queries."""
    return " OR ".join(f'"{t}"' for t in tokens(text)[:limit])


def signature_start(text: str, email_body: bool = False) -> int | None:
    """Where the first line ``--`` after any text begins; only in mail bodies."""
    if not email_body:
        return None
    m = re.search(r"(?m)^[^\S\n]*--[^\S\n]*$", text)
    while m and not text[: m.start()].strip():
        m = re.compile(r"(?m)^[^\S\n]*--[^\S\n]*$").search(text, m.end())
    return m.start() if m else None


def clean_body(text: str, boilerplate: bool = False, email_body: bool = False) -> str:
    """The part of a body that means something: nothing of boilerplate, of a mail neither signature nor disclaimer paragraphs, long lines once."""
    if boilerplate:
        return ""
    kept: list[str] = []
    seen: set[str] = set()
    skipping = False
    for line in text.split("\n"):
        if email_body and line.strip() == "--" and any(x.strip() for x in kept):
            break
        plain = for_search(line).lstrip(">").strip()
        if email_body and plain.casefold().startswith(DISCLAIMERS):
            skipping = True
        if skipping:  # to the next blank line
            skipping = bool(plain)
            continue
        if len(plain) > REPEATED_LINE:
            if plain in seen:
                continue
            seen.add(plain)
        kept.append(line)
    return for_search("\n".join(kept), dehyphenate=True)


#: Characters of a model's token (fixed value).
TOKEN_CHARS = 3.5


def approximate_tokens(text: str) -> int:
    """Number of model tokens where no model is at hand: one for 3.5 characters, at least one."""
    return max(1, math.ceil(len(text) / TOKEN_CHARS))


def compose(body: str, context: Iterable[tuple[str, str | None]], count: Callable[[str], int] = approximate_tokens) -> str:
    """Body, then ``Label: value`` lines of the context, each value once and short, as far as the budget of tokens goes."""
    lines, seen, left = [], set(), CONTEXT_TOKENS
    for label, value in context:
        shown = for_search(value)
        key = shown.upper()
        if not shown or key in seen:
            continue
        seen.add(key)
        low, high = 0, min(len(shown), CONTEXT_CHARS)
        while low < high:  # the longest prefix within the budget
            middle = (low + high + 1) // 2
            if count(f"{label}: {shown[:middle]}") <= left:
                low = middle
            else:
                high = middle - 1
        if not low:
            continue
        line = f"{label}: {shown[:low]}"
        lines.append(line)
        left -= count(line)
        if left <= 0:
            break
    return for_search("\n".join([body, *lines]))


def ends_sentence(word: str) -> bool:
    """Whether a word's final mark ends a sentence: stops of abbreviations, initials and short numbers do not."""
    core = word.rstrip(")]\"'”’»")
    if not core or core[-1] not in ".!?…。！？":
        return False
    if core[-1] != ".":
        return True
    stem = core[:-1].lstrip("([\"'“‘«")
    if not stem or "." in stem or len(stem) == 1 and stem.isalpha() or len(stem) <= 2 and stem.isdigit():
        return False
    return stem.lower() not in ABBREVIATIONS


def utf16_offset(text: str, offset: int) -> int:
    """An offset in code points as one in UTF-16 units."""
    return offset + sum(1 for c in text[:offset] if c > "￿")


def utf16_slice(text: str, start: int, length: int) -> str:
    """The part of a text at an offset and length in UTF-16 units."""
    return text.encode("utf-16-le", "surrogatepass")[2 * start : 2 * (start + length)].decode("utf-16-le", "surrogatepass")


def spreadsheet_column(number: int) -> str:
    """1 → A, 27 → AA."""
    out = ""
    while number > 0:
        number, rest = divmod(number - 1, 26)
        out = chr(65 + rest) + out
    return out


# Columns


def display_column(text: Column, table: bool = False) -> Column:
    """:func:`for_display` in the JVM; null gives an empty text."""
    soft = r"([\p{L}\p{M}])\x{AD} *\x{2028} *(\p{Ll})" if table else r"([\p{L}\p{M}])\x{AD}[ \t]*(?:\r\n|[\r\n\x{2028}])[ \t]*(\p{Ll})"
    out = F.regexp_replace(F.coalesce(text, F.lit("")), soft, "$1$2")
    out = F.regexp_replace(out, r"(?:\r\n|\r)", "\n")
    out = F.regexp_replace(out, r"[\p{Cc}\p{Cf}&&[^\n\t]]", "")
    if not table:
        out = F.regexp_replace(F.regexp_replace(out, r"[ \t]+\n", "\n"), r"(?U)^\s+|\s+$", "")
    return F.when(F.length(F.regexp_replace(out, r"(?U)\s+", "")) == 0, F.lit("")).otherwise(out)


def ascii_tokens(text: Column) -> Column:
    """Tokens of a text without marks to fold, in the JVM: runs of letters, marks, digits and underscores in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{M}\p{N}_]+"), F.lit(0))


def email_subject(text: Column) -> Column:
    """The first non-empty subject line."""
    found = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?mi)^Subject:[ \t]*(\S.*)$", 1)
    return F.when(found != "", F.regexp_replace(found, r"\s+$", ""))


def evidence_key(text: Column) -> Column:
    """Letters and digits only, in upper case."""
    return F.upper(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))


def independent_title(title: Column, *names: Column) -> Column:
    """The title, blank where it only repeats a file's or content's name, with or without its extension."""
    key = lambda c: F.upper(F.trim(F.regexp_replace(c, r"\s+", " ")))
    same = F.lit(False)
    for n in names:
        same = same | F.coalesce(key(title) == key(n), F.lit(False)) | F.coalesce(key(title) == key(F.regexp_replace(n, r"\.[^.]*$", "")), F.lit(False))
    return F.when(same | title.isNull(), F.lit("")).otherwise(title)


def error_summary(code: Column, message: Column) -> Column:
    """``code: message`` on one line, cut at 300 characters with an ellipsis."""
    flat = F.trim(F.regexp_replace(F.concat(code, F.lit(": "), message), r"\s+", " "))
    return F.when(F.length(flat) > 300, F.concat(F.substring(flat, 1, 297), F.lit("..."))).otherwise(flat)


def issue_cause(component: Column, message: Column) -> Column:
    """A message without the name of its component in front."""
    prefix = F.concat(component, F.lit(": "))
    return F.when(component.isNotNull() & message.startswith(prefix), F.substr(message, F.length(prefix) + 1)).otherwise(message)


def issue_signature(*parts: Column) -> Column:
    """The parts one after another, each with its length in front, so no two lists of parts look alike."""
    filled = [F.coalesce(p, F.lit("")) for p in parts]
    return F.concat(*[x for p in filled for x in (F.length(p).cast("string"), F.lit(":"), p, F.lit(";"))])


def contains_fold(text: Column, part: Column) -> Column:
    """Whether a text holds another, ignoring case."""
    return F.contains(F.upper(text), F.upper(part))


def _mapped(kind, f: Callable):
    @F.pandas_udf(kind)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda t: f(t) if isinstance(t, str) else f(None))

    return run


def search_column(text: Column, dehyphenate: bool = False) -> Column:
    return _mapped(T.StringType(), lambda t: for_search(t, dehyphenate))(text)


def name_key_column(text: Column) -> Column:
    return _mapped(T.StringType(), name_key)(text)


def canonical_column(text: Column) -> Column:
    return _mapped(T.StringType(), canonical)(text)


def tokens_column(text: Column) -> Column:
    """Canonical tokens with offsets: array<struct<value, start, length>>."""
    kind = T.ArrayType(T.StructType([T.StructField("value", T.StringType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType())]))
    return _mapped(kind, lambda t: [x._asdict() for x in tokenize(t)])(text)


def register(spark) -> None:
    """The text functions under SQL names."""
    spark.udf.register("lexical", _mapped(T.StringType(), canonical))
    spark.udf.register("name_key", _mapped(T.StringType(), name_key))
    spark.udf.register("for_search", _mapped(T.StringType(), for_search))
    spark.udf.register("ends_sentence", _mapped(T.BooleanType(), lambda t: ends_sentence(t or "")))
