"""Continuous paragraphs from the lines of scanned pages and the blocks of PDF pages."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from hashlib import md5
from statistics import median
from uuid import uuid4

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import keep, ship

# States of the units of a page, in the order of a page: header, title, start of a paragraph (break), its continuation, footer, page number.
HEADER, TITLE, BREAK, BODY, FOOTER, NUMBER = range(6)

#: Parts of a page, from its top and bottom, in which running lines and page numbers are looked for.
MARGIN = 0.15
#: A margin text is repeated when it stands on at least two pages and this part of the document's pages, or on this many pages near each other:
#: in one span of NEAR pages or the two beside it. Short keys need one page more.
REPEATED, NEAR, NEAR_PAGES, NEAR_LETTERS = 0.1, 4, 2, 6
#: Margin keys longer than this are written as their digest.
LONG_KEY = 64
#: Words at least this frequent among all words are in the lexicon, which so has at most 1/LEXICON_SHARE entries.
LEXICON_SHARE = 2e-6
LEXICON_LEAST = 3
#: A word is a misreading of another that is so many times as frequent and differs by a confusion of characters.
RATIO_KNOWN, RATIO_NEW = 12, 6
#: A line's confidence lowers or raises what is asked of a misreading, by DOUBT_NEED, where lines of about its confidence hold sure misreadings
#: (signs inside words) so many times as often, or as rarely, as all lines do. Confidences are taken in steps of CONFIDENCE_STEP.
DOUBT_NEED = {1: 0.5, 0: 1.0, -1: 1.5}
DOUBT_ODDS, DOUBT_LEAST, CONFIDENCE_STEP = 3.0, 50, 1
#: Right forms of rare words that are sent to all executors; where there are more, they are joined with the words of the pages.
RARE_SENT = 100_000

#: Confusions of scanners: what is read, and what it may stand for (fixed values).
CONFUSED = {
    "c": "e", "e": "c", "@": "a", "0": "o", "l": "i", "i": "l", "f": "t", "t": "f", "†": "t", "ri": "n", "n": "ri", "5": "s", "ii": "u ü n", "u": "ii", "cl": "d", "d": "cl", "1": "l i", "9": "g q",
    "rn": "m", "m": "rn", "b": "h", "h": "b li", "6": "é b", "vv": "w", "w": "vv", "g": "ç q", "8": "b B", "I": "l", "|": "l I", "!": "l i", "¢": "c", "€": "e", "£": "e", "$": "s", "3": "e", "O": "0", "im": "nn", "nn": "im",
    "a~": "ã", "o~": "õ", "n~": "ñ",
}

#: Letters read for digits (fixed values).
FOR_DIGIT = {"O": "0", "o": "0", "D": "0", "Q": "0", "l": "1", "I": "1", "i": "1", "|": "1", "Z": "2", "z": "2", "S": "5", "s": "5", "B": "8", "b": "6", "G": "6", "g": "9", "q": "9", "A": "4", "T": "7"}
#: Letters read for digits that stand beside a digit in hardly any code or measure (fixed values).
BARE = "OoIi|"
#: Words beside which a number stands, in front of it and after it (fixed values).
BEFORE_NUMBER = set("""page pages pag pag. pág pág. p. pp. seite seiten s. bl. no no. nr nr. n° nº núm. num. number nummer numéro número numero chapter kapitel chapitre capítulo capitolo hoofdstuk
section abschnitt artikel article artículo artigo articolo § step schritt étape paso passo about over under von bis vom am from to until le el dal del le""".split())
AFTER_NUMBER = set("""% € $ £ °c kg g mg t km m cm mm h min s l ml kw kwh v a hz bar eur usd gbp euro euros uhr hours hour minutes days weeks months years tage stunden minuten wochen monate jahre jours heures mois
ans días horas meses años dias anos giorni ore mesi anni dagen uren weken maanden jaar pages seiten pieces stück pallets
january february march april may june july august september october november december januar februar märz mai juni juli oktober dezember janvier février mars avril juin juillet août septembre octobre novembre décembre
enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre janeiro fevereiro março maio junho julho setembro outubro novembro dezembro gennaio febbraio aprile maggio giugno luglio settembre ottobre dicembre
januari februari maart mei augustus""".split())
#: Signs that stand in no word (fixed values).
ODD = "�†‡@¢£€¥©®|¦^~<>{}\\=*#$§"
# What no confusion changes: letters that none touches, with those that one takes for another written alike. Every pair of CONFUSED has one skeleton.
_SKELETON = str.maketrans("f†@àáâãä0ôóöõ5ß$9çq", "ttaaaaaaooooosssggg", "eéèêëcilíìîï1|rnmuüúùûhbdwv68!¢€£3~ñ")
_NO_SIGN = str.maketrans("", "", ODD + "!0123456789")
_RIGHTS = {piece: rights.split() for piece, rights in CONFUSED.items()}
HYPHENS = "-‐‑¬­"
#: Any letter, tried for a character that was lost (fixed values).
LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïñòóôõöøùúûüýœ"

_OUTER = ".,;:()?!\"'«»“”„‚‘’[]…–—"
_WORD = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")
_CODE = re.compile(r"(?:[A-Z]{2,}|\d+)(?:[-/.](?:[A-Z]{2,}|\d+))+|\d+")
_FINAL = re.compile(r"[.!?…:]['\"»”“’)\]]*\s*\Z")
_MAIL = re.compile(r"[^\s@]+@[^\s@]+\.\w+|\w+://\S+|www\.\S+")
_ROMAN = re.compile(r"(?=[ivxlcdm])m{0,3}(?:c[md]|d?c{0,3})(?:x[cl]|l?x{0,3})(?:i[xv]|v?i{0,3})", re.I)
_NUMBER = re.compile(r"[\[(\-–—~ ]*(?:(?:page|pag|pág|seite|seit|pagina|página|p|s|pg|bl|blatt|folio|f)\b[. ]*)?([0-9OolISBZ]{1,5}|[ivxlcdm]{1,15})(?:[ ]*(?:/|of|von|de|di|van|sur|\|)[ ]*[0-9OolISBZ]{1,5})?[\])\-–—~. ]*", re.I)
_DATE = re.compile(r"\d{1,2}[./-]\d{1,2}[./-](?:\d{2}|\d{4})|\d{4}-\d{2}-\d{2}|\d{1,2}:\d{2}(?::\d{2})?|\d+,\d{2}")
_SIDE = re.compile(r"^([\[(\-–]*[0-9OolISB]{1,5}[\])\-–.]*)\s{2,}(.+)$|^(.+?)\s{2,}([\[(\-–]*[0-9OolISB]{1,5}[\])\-–.]*)$")

# The key of a margin text keeps only letters that scanners seldom take for, or make of, others; of the rest, like ones are written alike.
_KEY_FROM, _KEY_TO = "f†@àáâãä0ôóöõ5ß9ç", "ttaaaaaaooooossgg"
_KEY_DROP = "eéèêëcilíìîï1|rnmuüúùûhbdwv68�"
# Where too little is left, all letters count, by classes: letters of upright strokes, however many, as one i, d as c and strokes, w as two v.
_CLASS_FROM, _CLASS_TO = _KEY_FROM + "eéèêë3¢€£" + "lrnmhub1|!8íìîïñüúùû", _KEY_TO + "c" * 9 + "i" * 20
_OPENING = r"^[^\w]*\d{1,5}[^\w]*\s{2,}|\s{2,}[^\w]*\d{1,5}[^\w]*$"


@lru_cache(1 << 14)
def margin_key(text: str) -> str:
    """What a margin text and its misreadings have in common; empty for bare numbers and texts of a few letters."""
    t = re.sub(_OPENING, " ", text.lower())
    key = re.sub("[^a-zA-Z]+", "", t.translate(_KEY_MAP))
    if len(key) < 3:
        key = "~" + re.sub("i+", "i", re.sub("[^a-z]+", "", t.replace("d", "cl").replace("w", "vv").translate(_CLASS_MAP)))
        return key if len(key) > 3 else ""
    return key if len(key) <= LONG_KEY else md5(key.encode()).hexdigest()


_KEY_MAP = {ord(a): b for a, b in zip(_KEY_FROM, _KEY_TO, strict=True)} | {ord(c): "" for c in _KEY_DROP}
_CLASS_MAP = {ord(a): b for a, b in zip(_CLASS_FROM, _CLASS_TO, strict=True)}


def margin_key_column(text: Column) -> Column:
    """:func:`margin_key` as a column."""
    t = F.regexp_replace(F.lower(text), _OPENING.replace(r"[^\w]", r"[^\p{L}\p{N}_]"), " ")
    key = F.regexp_replace(F.translate(t, _KEY_FROM + _KEY_DROP, _KEY_TO), "[^a-zA-Z]+", "")
    classes = F.concat(F.lit("~"), F.regexp_replace(F.regexp_replace(F.translate(F.replace(F.replace(t, F.lit("d"), F.lit("cl")), F.lit("w"), F.lit("vv")), _CLASS_FROM, _CLASS_TO), "[^a-z]+", ""), "i+", "i"))
    return F.when(F.length(key) > LONG_KEY, F.md5(key)).when(F.length(key) > 2, key).when(F.length(classes) > 3, classes).otherwise("")


@dataclass
class Unit:
    """A line or block of a page."""

    id: int
    text: str
    confidence: float | None
    top: float | None = None
    height: float = 0.0
    left: float = 0.0
    width: float = 0.0
    table: bool = False
    native: bool = False  # text that was not recognised, and so not misread
    state: int = BODY
    number: bool = False
    running: bool = False
    defects: set[str] = field(default_factory=set)


def is_number(text: str, page: int | None) -> int:
    """0: no page number; 1: in the form of one; 2: of this page."""
    m = _NUMBER.fullmatch(text.strip())
    if not m:
        return 0
    raw = m[1]
    digits = "".join(FOR_DIGIT.get(c, c) for c in raw)
    if raw.lower() == roman(page) or digits.isdigit() and page is not None and int(digits) == page:
        return 2
    if not raw.isalpha() or not set(raw.lower()) <= set("ivxlcdm"):
        return 1 if any(c.isdigit() for c in raw) or text.strip() != raw else 0
    return 1 if _ROMAN.fullmatch(raw) and (len(raw) > 1 or text.strip() != raw) else 0


def roman(n: int | None) -> str | None:
    if n is None or not 0 < n < 4000:
        return None
    out = ""
    for value, sign in ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        while n >= value:
            out, n = out + sign, n - value
    return out


# Log-odds of the states' changes; what is not listed is impossible.
_NEXT = {
    None: {HEADER: -0.7, TITLE: -0.7, BREAK: -0.7, BODY: -0.7, NUMBER: -1.5, FOOTER: -3.0},
    HEADER: {HEADER: -2.0, NUMBER: -1.5, TITLE: -1.0, BREAK: -0.7, BODY: -0.7, FOOTER: -4.0},
    TITLE: {TITLE: -3.0, BREAK: -0.1, BODY: -4.0, FOOTER: -3.0, NUMBER: -3.0},
    BREAK: {BREAK: -1.5, BODY: -0.4, FOOTER: -2.0, NUMBER: -2.0},
    BODY: {BREAK: -1.5, BODY: -0.4, FOOTER: -2.0, NUMBER: -2.0},
    FOOTER: {FOOTER: -1.5, NUMBER: -0.5},
    NUMBER: {HEADER: -1.5, FOOTER: -1.5, BREAK: -1.5, BODY: -1.5, TITLE: -2.0, NUMBER: -4.0},
}


def label_page(units: list[Unit], page: int | None, repeated: dict[str, int]) -> None:
    """Gives each unit of a page its state: the best path of a hidden Markov model over the units from top to bottom.

    Observed of a unit: the margin it stands in, the white above and below it against the page's usual white, whether its key is repeated
    over the document's pages, the form of a page number, its width against the page's widest, and how the text before and its own begin
    and end. Without a layout the margins count by order."""
    if not units:
        return
    whites = []
    for a, b in zip(units, units[1:]):
        if a.top is not None and b.top is not None:
            whites.append(max(0.0, b.top - a.top - a.height))
    usual = max(0.004, median(whites)) if len(whites) >= 3 else 0.0125
    widest = max((u.width for u in units), default=0.0) or 1.0
    longest = max(len(x) for u in units for x in u.text.split("\n"))
    n = len(units)
    best: list[dict[int, tuple[float, int | None]]] = []
    ended = True  # the text before ends a sentence
    for i, u in enumerate(units):
        text = u.text.strip()
        top = u.top if u.top is not None else (0.05 if i == 0 else 0.95 if i == n - 1 else 0.5)
        above = (top - units[i - 1].top - units[i - 1].height) / usual if i and units[i - 1].top is not None else None
        below = (units[i + 1].top - top - u.height) / usual if i + 1 < n and units[i + 1].top is not None else None
        margin = top < MARGIN or top > 1 - MARGIN
        known = margin and bool(repeated) and repeated.get(margin_key(text), 0) >= 2
        number = is_number(text, page) if margin or len(text) < 24 else 0
        narrow = u.width < 0.72 * widest or len(text) < 0.62 * longest or n == 1
        upper_first = text[:1].isupper() or not text[:1].isalpha()
        ends = bool(_FINAL.search(text))
        emit: dict[int, float] = {}
        if not u.table:
            if top < MARGIN:
                far = below is not None and below >= 1.6
                emit[HEADER] = (2.5 if known else -1.0) + (2.5 if far else -2.5) + (0.5 if narrow else -3.0) + (0.5 if upper_first else -2.0) - (4.0 if ends and not known else 0.0) - (1.5 if page == 1 else 0.0)
            if page in (1, None) and i <= 2 and top < 0.3 and narrow and upper_first and not ends and n > 1 and number < 2:
                emit[TITLE] = 5.0 + (0.5 if known else 0.0)
            if top > 1 - MARGIN and number < 2:
                far = above is not None and above >= 1.6
                emit[FOOTER] = (2.5 if known else -1.0) + (2.5 if far else -2.5) + (0.5 if narrow else -3.0) + (0.5 if upper_first else -2.0)
            if number and margin:
                emit[NUMBER] = 5.0 if number == 2 else 2.0
        body = (-2.5 if known else 0.0) - (2.0 if top > 0.91 else 0.0) - (1.0 if number == 2 and top > 1 - MARGIN else 0.0)
        before = units[i - 1] if i else None
        if before is None:
            starts = 0.0 if upper_first else -3.0
        else:
            short = before.width < 0.93 * widest
            starts = (1.0 if ended else -3.0) + (1.0 if short else -1.0) + (0.5 if upper_first else -3.0) + (1.0 if above is not None and above >= 1.5 else 0.0) + (2.0 if u.table or before.table else 0.0)
        ended = ends
        emit[BREAK] = body + starts
        emit[BODY] = body
        column: dict[int, tuple[float, int | None]] = {}
        for s, e in emit.items():
            if not best:
                column[s] = (_NEXT[None].get(s, -30.0) + e, None)
                continue
            top_score, prev = -1e9, None
            for r, (v, _) in best[-1].items():
                v += _NEXT[r].get(s, -30.0)
                if v > top_score:
                    top_score, prev = v, r
            column[s] = (top_score + e, prev)
        best.append(column)
    state: int | None = max(best[-1], key=lambda s: best[-1][s][0])
    for i in range(n - 1, -1, -1):
        units[i].state = state  # type: ignore[assignment]
        state = best[i][state][1]  # type: ignore[index]
    for u in units:
        if u.state in (HEADER, FOOTER):
            m = _SIDE.match(u.text.strip())
            u.number = bool(m)
            u.running = True
        elif u.state == NUMBER:
            u.number = True
            m = _SIDE.match(u.text.strip())


class Lexicon:
    """Frequent words of the corpus with their counts, and what follows from them."""

    MEMO = 200_000

    def __init__(self, counts: dict[str, int], least: int, rare: dict[str, str] | None = None, doubts: dict[int, int] | None = None, longest: int | None = None):
        self.counts, self.least, self.rare, self.doubts = counts, least, rare, doubts or {}
        self.settled = max(counts.values(), default=0) / RATIO_KNOWN / DOUBT_NEED[1]  # words that no other is so much more frequent than
        self.longest = (1 << 30) if longest is None else longest  # of all words, not of the frequent ones only
        self.skeletons = self._skeletons()
        self.fine: tuple[set[str], ...] = (set(), set(), set())  # tokens without a wrong character whatever stands beside them, by doubt
        self.memos: tuple[dict[str, tuple[bool, str]], ...] = ({}, {}, {})  # by doubt

    def doubt(self, confidence: float | None) -> int:
        """1 for a confidence at which misreadings are frequent, -1 where they are rare, 0 between and where there is none."""
        return 0 if confidence is None or confidence != confidence else self.doubts.get(int(min(max(confidence, 0.0), 100.0) // CONFIDENCE_STEP), 0)

    def _skeletons(self) -> dict[str, tuple[int, int]]:
        """The skeletons of words frequent enough to be what a misreading stands for, with their least and greatest lengths."""
        of: dict[str, int] = {}
        for w, n in self.counts.items():
            of[w.lower()] = of.get(w.lower(), 0) + n
        out: dict[str, tuple[int, int]] = {}
        for w, n in of.items():
            if n >= min(RATIO_NEW * self.least, RATIO_KNOWN) * DOUBT_NEED[1]:
                key = w.translate(_SKELETON)
                low, high = out.get(key, (len(w), len(w)))
                out[key] = min(low, len(w)), max(high, len(w))
        return out

    def count(self, word: str) -> int:
        n = self.counts.get(word, 0)
        if word[:1].isupper():
            n += self.counts.get(word.lower(), 0) if not word.isupper() else 0
        return n

    def judge(self, token: str, rare: dict[str, str] | None = None, before: str = "", after: str = "", doubt: int = 0) -> tuple[bool, str]:
        """Whether a token has a wrong character, and the token put right as far as its right form is known.

        ``rare`` holds the right forms of words below the lexicon (:func:`rare_words`), which are known for whole tokens of a page only; the tokens beside this one tell whether a number is expected; ``doubt`` is that
        of its line's confidence."""
        if rare:
            core = token.strip(_OUTER)
            if core in rare:
                at = token.index(core)
                return True, token[:at] + rare[core] + token[at + len(core) :]
        if len(token) < 8 and len(core := token.strip(_OUTER)) == 2 and self._two(core, before, after):
            return True, token.replace(core, "".join(FOR_DIGIT.get(c, c) for c in core))
        if doubt and self.counts.get(token, 0) > self.settled:
            doubt = 0
        memo = self.memos[doubt]
        got = memo.get(token)
        if got is None:
            if len(memo) >= self.MEMO:
                memo.clear()
            got = memo[token] = self._judge(token, doubt)
        return got

    @staticmethod
    def _two(core: str, before: str, after: str) -> bool:
        """Whether a digit and a letter on their own are a number: by the letter, or where a number is expected."""
        if sum(c.isdigit() for c in core) != 1 or not all(c.isdigit() or c in FOR_DIGIT for c in core):
            return False
        letter = core[0] if core[1].isdigit() else core[1]
        if letter in BARE or letter == "l" and core[0] == "l":
            return True
        return before.strip("(").lower() in BEFORE_NUMBER and letter != "l" or after.strip(_OUTER).lower() in AFTER_NUMBER

    @staticmethod
    def _short_part(parts: list[str], k: int) -> bool:
        """Whether a digit and a letter are a number as a part of a date, time or decimal: the other parts are digits, or read for digits."""
        if len(parts) < 3 or not all(re.fullmatch(r"[-/.,:]", p) for p in parts[1::2]):
            return False
        if not all(p and any(c.isdigit() for c in p) and all(c.isdigit() or c in FOR_DIGIT for c in p) for p in parts[::2]):
            return False
        if _DATE.fullmatch("".join(FOR_DIGIT.get(c, c) if i % 2 == 0 else c for i, p in enumerate(parts) for c in p)):
            return True
        letter = next(c for c in parts[k] if c.isalpha() or c == "|")
        litres = k == len(parts) - 1 and parts[k][1] == "l"
        return letter in BARE + "l" and not litres or k > 0 and parts[0].isdigit() and parts[k - 1] in ".," and not litres

    def _judge(self, token: str, doubt: int = 0) -> tuple[bool, str]:
        core = token.strip(_OUTER)
        if _CODE.fullmatch(core):
            return False, token
        if len(core) < 2 or not any(c.isalpha() or c == "�" for c in core) or _MAIL.fullmatch(core):
            return False, token
        at = token.index(core)
        around = lambda s: token[:at] + s + token[at + len(core) :]
        if self.count(core) >= 1000 * self.least:
            return False, token
        if any(c.isdigit() for c in core):
            wrong, parts = False, re.split(r"([-/.,:'’])", core)
            read = list(parts)
            for k, part in enumerate(parts):
                digits = sum(c.isdigit() for c in part)
                letters = sum(c.isalpha() for c in part)
                if len(part) == 2 and digits == 1 and (letters or "|" in part) and self._short_part(read, k):
                    wrong, parts[k] = True, "".join(FOR_DIGIT.get(c, c) for c in part)
                    continue
                if not digits or not letters or len(part) < 3:
                    continue
                if letters <= digits or letters < 3 and all(c.isdigit() or c in FOR_DIGIT for c in part):
                    if all(c.isdigit() or c in FOR_DIGIT for c in part):
                        wrong, parts[k] = True, "".join(FOR_DIGIT.get(c, c) for c in part)
                elif any(c.islower() for c in part):
                    found = self._nearest(part)
                    wrong = True
                    parts[k] = found or part
            if wrong and self.count("".join(parts)) < self.least:
                found = self._nearest(core)
                if found:
                    return True, around(found)
            return wrong, around("".join(parts))
        odd = any(c in ODD for c in core)
        found = self._nearest(core, doubt=doubt)
        if not found and not odd and not self.count(core) and ("-" in core or "'" in core or "’" in core):
            parts = re.split(r"([-'’])", core)
            judged = [self._nearest(p, doubt=doubt) if len(p) > 2 and not self.count(p) else None for p in parts]
            if any(judged):
                return True, around("".join(j or p for j, p in zip(judged, parts)))
        return bool(found) or odd, around(found or core)

    def _nearest(self, word: str, exact: int | None = None, others: list[tuple[int, int, str]] | None = None, doubt: int = 0) -> str | None:
        """The much more frequent word that this one, by one or two confusions, may stand for.

        ``exact`` is the count of a word below the lexicon; ``others`` then takes (confusions, least count, form) of the forms that may be below it too."""
        own = self.count(word)
        need = RATIO_KNOWN * own if own else RATIO_NEW * self.least
        if exact is not None:
            need = min(need, RATIO_KNOWN * exact)
        if len(word) < 3:
            need *= 4
        need *= DOUBT_NEED[doubt]
        best, score = None, 0
        # each confusion takes away one sign that words don't have, and one character at most
        odd = len(word) - len(word.translate(_NO_SIGN))
        if odd > 2 or len(word) - 2 > self.longest:
            return None
        if others is None and "�" not in word:
            # two confusions change a length by two at most, and the skeleton never
            low, high = self.skeletons.get(word.lower().translate(_SKELETON), (1 << 30, 0))
            if not low - 2 <= len(word) <= high + 2:
                return None
        seen = {word}
        level = [word]
        for depth in range(2):
            nxt = []
            for w in level:
                signs = odd and len(w) - len(w.translate(_NO_SIGN))
                for i in range(len(w)):
                    for size in (1, 2):
                        piece = w[i : i + size]
                        if len(piece) < size:
                            continue
                        rights = LETTERS if piece == "�" else _RIGHTS.get(piece)
                        if not rights:
                            continue
                        left = signs and signs > len(piece) - len(piece.translate(_NO_SIGN))  # right forms have none
                        for right in rights:
                            made = w[:i] + right + w[i + size :]
                            if made in seen:
                                continue
                            seen.add(made)
                            if left:
                                if not depth:
                                    nxt.append(made)
                                continue
                            n = self.count(made)
                            if n > score and n >= need * (4 if depth else 1):
                                best, score = made, n
                            elif others is not None and n < self.least and need * (4 if depth else 1) < self.least:
                                others.append((depth, need * (4 if depth else 1), made))
                            nxt.append(made)
            if best or len(word) < 6 and not any(c in ODD or c.isdigit() for c in word):
                break
            level = nxt
        return best

    def cut(self, left: str, right: str) -> bool:
        """Whether a line end after ``left`` and its hyphen cuts a word that goes on with ``right``, rather than the hyphen being its own."""
        a, sign, b = left[:-1].lstrip(_OUTER), left[-1], right.rstrip(_OUTER)
        if not a or not a[-1].isalpha():
            return False
        if sign in "¬­" and (not b or b[0].isalpha()):
            return True
        if not b:
            return a[-1].islower()
        if not b[0].isalpha() or not b[0].islower() or a.isupper() and len(a) > 1:
            return False
        whole, own = self.count(a + b), self.count(a + "-" + b)
        if own or whole:
            return whole > own
        tail = a.split("-")[-1]
        if "-" in a and self.count(tail + b):
            return True
        (_, joined), (_, split) = self.judge(a + b), self.judge(a + "-" + b)
        whole, own = self.count(joined), self.count(split)
        if own or whole:
            return whole >= own
        if joined != a + b:
            return True
        if split != a + "-" + b and "-" in split:
            return False
        return not (self.count(a) >= 2 * self.least and self.count(b) >= 2 * self.least and len(a) > 2 and len(b) > 2)


def ends_hyphen(text: str) -> str | None:
    """The last word of a line, with its hyphen, where the line ends in one."""
    t = text.rstrip()
    if len(t) < 2 or t[-1] not in HYPHENS or not t[-2].isalpha() and t[-2] not in ODD and not t[-2].isdigit():
        return None
    return t.split()[-1]


def read_page(units: list[Unit], lexicon: Lexicon, page: int | None, repeated: dict[str, int], rare: dict[str, str] | None = None) -> dict:
    """Labels the units of a page, finds their defects and builds the page's paragraphs.

    Words cut within the page are judged as wholes. The first word and a cut last word of the page's running text may go on from or to another
    page and are left to :func:`bridge`: they come back as ``first`` and ``last`` with their units. Titles and tables are paragraphs of their own,
    in ``others``, with their place (``no``) among the page's paragraphs; titles are put right, tables left as they are. Lines of digits only are
    part of the text, but no word is cut by them. A paragraph's ``head`` is the page's first word put right, for where no cut word goes on in it.

    ``rare`` has the words of this page, where not those of all pages are in the lexicon. Either way the same tokens meet them: whole ones, but none made of
    a cut word's parts, which is looked up in the lexicon only."""
    label_page(units, page, repeated)
    rare = rare or lexicon.rare
    rows: list[tuple[Unit, list[str], bool]] = []  # lines of running text: unit, tokens, first of its paragraph
    digits: set[int] = set()  # rows of digits only
    others: list[tuple[int, bool, str]] = []  # rows before a title or table, whether a title, text
    for u in units:
        if u.running:
            u.defects.add("running")
        if u.number:
            u.defects.add("page_number")
        if u.table or u.state == TITLE:
            text = u.text.strip()
            if not u.table:
                text = " ".join(t if u.native else lexicon.judge(t, rare, doubt=lexicon.doubt(u.confidence))[1] for t in text.split())
                if others and others[-1][:2] == (len(rows), True):
                    text = others.pop()[2] + " " + text
            if text:
                others.append((len(rows), not u.table, text))
        if u.table or u.state not in (BREAK, BODY):
            continue
        bare = re.fullmatch(r"[\d\s.,/]*", u.text)
        for k, line in enumerate(u.text.split("\n")):
            tokens = line.split()
            if tokens:
                if bare:
                    digits.add(len(rows))
                rows.append((u, tokens, k == 0 and u.state == BREAK))
    out: dict = {"first": None, "last": None, "paragraphs": [], "others": []}
    words = [k for k in range(len(rows)) if k not in digits]
    after = dict(zip(words, words[1:]))
    head = None
    for k, (u, tokens, _) in enumerate(rows):
        if k in digits:
            continue
        follow = rows[after[k]] if k in after else None
        opens = k == words[0]
        held = ends_hyphen(tokens[-1])
        doubt = lexicon.doubt(u.confidence)
        fixed = list(tokens)
        fine = lexicon.fine[doubt]
        for i, t in enumerate(tokens if not u.native else ()):
            if t in fine:
                continue
            if opens and i == 0 or i == len(tokens) - 1 and held:
                continue
            if i == 0 and t.startswith("\x00"):
                fixed[0] = t[1:]
                continue
            wrong, fixed[i] = lexicon.judge(t, rare, tokens[i - 1] if i else "", tokens[i + 1] if i + 1 < len(tokens) else "", doubt)
            if wrong:
                u.defects.add("misread")
            elif len(t.strip(_OUTER)) != 2:
                if len(fine) >= lexicon.MEMO:
                    fine.clear()
                fine.add(t)
        if opens:
            # judged when it is known whether the page before ends in its first part
            wrong, right = lexicon.judge(tokens[0], rare, "", tokens[1] if len(tokens) > 1 else "", doubt)
            out["first"] = {"unit": u.id, "token": tokens[0], "whole": not (len(tokens) == 1 and held), "native": u.native, "wrong": wrong}
            if wrong and not u.native and not (len(tokens) == 1 and held):
                if k:
                    fixed[0] = right
                else:
                    head = right
            if len(tokens) == 1 and held:
                held = None
        if held:
            left = tokens[-1]
            if follow is None:
                out["last"] = {"unit": u.id, "token": left, "native": u.native}
            else:
                right = follow[1][0]
                if lexicon.cut(left, right):
                    u.defects.add("hyphen")
                    wrong, whole = lexicon.judge(left[:-1] + right)
                    if wrong:
                        at = next((i for i, (a, b) in enumerate(zip(left[:-1] + right, whole)) if a != b), len(left))
                        odd = [i for i, c in enumerate(left[:-1] + right) if c in ODD or c.isdigit()]
                        at = odd[0] if odd else at
                        at_fault = u if at < len(left) - 1 else follow[0]
                        if not at_fault.native:
                            at_fault.defects.add("misread")
                    fixed[-1] = whole
                    follow[1][0] = "\x00"
                elif len(follow[1]) == 1 and ends_hyphen(right):
                    fixed[-1] = left
                else:
                    wrong, whole = lexicon.judge(left + right)
                    if wrong:
                        at = next((i for i, (a, b) in enumerate(zip(left + right, whole)) if a != b), len(left))
                        at_fault = u if at < len(left) else follow[0]
                        if not at_fault.native:
                            at_fault.defects.add("misread")
                    fixed[-1] = whole
                    follow[1][0] = "\x00"
        rows[k] = (u, [t for t in fixed if t and t != "\x00"], rows[k][2])
    for k, (u, tokens, starts) in enumerate(rows):
        if k == 0 or starts:
            while others and others[0][0] <= k:
                out["others"].append({"no": len(out["paragraphs"]) + len(out["others"]), "text": others.pop(0)[2]})
            out["paragraphs"].append({"open": k == 0 and not starts, "text": "", "head": head if k == 0 else None, "no": len(out["paragraphs"]) + len(out["others"])})
        p = out["paragraphs"][-1]
        p["text"] += (" " if p["text"] and tokens else "") + " ".join(tokens)
    out["others"] += [{"no": len(out["paragraphs"]) + k, "text": text} for k, (_, _, text) in enumerate(others, len(out["others"]))]
    for p in out["paragraphs"]:
        p["done"] = bool(_FINAL.search(p["text"]))
    return out


def bridge(left: str | None, right: str | None, lexicon: Lexicon) -> tuple[bool, bool, bool]:
    """For a cut word at a page's end and the first word of the next: (hyphen, left misread, right misread)."""
    if left is None:
        return False, False, bool(right) and lexicon.judge(right)[0]
    odd = lambda s: any(c in ODD or c.isdigit() for c in s)
    if right is None:
        return lexicon.cut(left, ""), any(c in ODD for c in left[:-1]), False
    if not lexicon.cut(left, right):
        return False, odd(left[:-1]) and lexicon.judge(left[:-1])[0], lexicon.judge(right)[0]
    wrong, whole = lexicon.judge(left[:-1] + right)
    if not wrong:
        return True, False, False
    at = next((i for i, (a, b) in enumerate(zip(left[:-1] + right, whole)) if a != b), len(left))
    marks = [i for i, c in enumerate(left[:-1] + right) if c in ODD or c.isdigit()]
    at = marks[0] if marks else at
    return True, at < len(left) - 1, at >= len(left) - 1


# Tables


def units_of(lines: DataFrame | None, blocks: DataFrame | None) -> DataFrame:
    """Both tables in one form. Rows with a null id, document or page stand alone."""
    parts = []
    for df, name, key, order, is_table, native in ((lines, "ocr_lines", "line_id", "line_no", F.lit(False), F.lit(False)),
                                                   (blocks, "pdf_blocks", "block_id", "ordinal", F.coalesce(F.col("is_table"), F.lit(False)), F.coalesce(F.col("extraction_method") == "NativeText", F.lit(False)))):
        if df is None:
            continue
        r = F.col("page_region")
        parts.append(df.where(F.col(key).isNotNull()).select(
            F.lit(name).alias("unit_table"), F.coalesce(F.col("document_id"), F.concat(F.lit("\x00"), F.col(key).cast("string"))).alias("doc"), F.col("page_number").cast("int").alias("page"),
            F.when(F.col("page_number").isNull(), F.col(key).cast("string")).alias("alone"),
            F.struct(F.col(order).cast("int").alias("no"), F.col(key).cast("bigint").alias("id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), F.col("confidence").cast("double").alias("conf"),
                     r["y"].alias("y"), r["height"].alias("h"), r["x"].alias("x"), r["width"].alias("w"), is_table.alias("table"), native.alias("native")).alias("u")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def repeated_keys(units: DataFrame) -> DataFrame:
    """(unit_table, doc, page, key, n): the margin keys of each page that are repeated over its document or over pages near it, with their numbers
    of pages.

    Counted by document, key and span of pages with partial aggregation over the margin units only; none is gathered by document."""
    y = F.col("u.y")
    margin = units.where((F.col("page").isNotNull()) & ((y < MARGIN) | (y > 1 - MARGIN) | y.isNull()) & ~F.col("u.table"))
    seen = keep(margin.select("unit_table", "doc", "page", margin_key_column(F.col("u.text")).alias("key")).distinct().withColumn("span", F.floor(F.col("page") / NEAR)))
    seen = seen.where("key <> ''")  # after keeping: below it the keys would be made twice
    spans = seen.groupBy("unit_table", "doc", "key", "span").agg(F.count(F.lit(1)).alias("k"))
    of_doc = seen.select("unit_table", "doc", "page").distinct().groupBy("unit_table", "doc").agg(F.count(F.lit(1)).alias("m"))
    n = spans.groupBy("unit_table", "doc", "key").agg(F.sum("k").alias("n")).where("n >= 2").join(of_doc, ["unit_table", "doc"]).withColumn("often", F.col("n") >= REPEATED * F.col("m")).drop("m")
    near = spans.select("unit_table", "doc", "key", F.explode(F.array(F.col("span") - 1, "span", F.col("span") + 1)).alias("span"), "k").groupBy("unit_table", "doc", "key", "span").agg(F.sum("k").alias("near"))
    held = (near.join(n, ["unit_table", "doc", "key"]).where(F.col("often") | (F.col("near") >= NEAR_PAGES + F.when(F.length("key") < NEAR_LETTERS, 1).otherwise(0)))
            .select("unit_table", "doc", "key", "span", F.when(F.col("often"), F.col("n")).otherwise(F.col("near")).alias("n")))
    return seen.join(held, ["unit_table", "doc", "key", "span"]).drop("span")


def learn_doubts(units: DataFrame) -> dict[int, int]:
    """For each step of confidence in which misreadings are far more, or less, frequent than in all lines, 1 or -1.

    Misreadings that need no lexicon are counted, a sign or digit between small letters, in one aggregation of at most 101 rows."""
    signs = "".join("\\" + c if c in "\\^|~[]{}" else c for c in ODD)
    odd = F.col("u.text").rlike(rf"\p{{Ll}}[{signs}0-9]\p{{Ll}}").cast("int")
    step = F.floor(F.least(F.greatest(F.col("u.conf"), F.lit(0.0)), F.lit(100.0)) / CONFIDENCE_STEP).cast("int")
    rows = units.where(F.col("u.conf").isNotNull() & ~F.isnan("u.conf") & ~F.col("u.native") & ~F.col("u.table")).groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("n"), F.sum(odd).alias("k")).collect()
    n, k = sum(r["n"] for r in rows), sum(r["k"] for r in rows)
    odds = lambda k, n: (k + 0.5) / (n - k + 0.5)
    return {r["s"]: 1 if ratio >= DOUBT_ODDS else -1 for r in rows if r["n"] >= DOUBT_LEAST and ((ratio := odds(r["k"], r["n"]) / odds(k, n)) >= DOUBT_ODDS or ratio <= 1 / DOUBT_ODDS)}


def build_lexicon(units: DataFrame, held: int = 500_000) -> tuple[dict[str, int], int, DataFrame]:
    """The frequent words of all running text, at most 1 / LEXICON_SHARE entries, the least count of a word among them, and the kept counts (w, odd, n)
    of all words; ``odd`` ones have a sign or digit that no word has. A task holds about ``held`` different words before it passes their counts on, which
    changes nothing in the sums."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[str, int] = {}

        def rows() -> Iterator[pd.DataFrame]:
            words = [(w, n, odd) for w, n in counts.items() if not (odd := not _WORD.fullmatch(w)) or odd_word(w)]
            if words:
                yield pd.DataFrame({"w": [w for w, _, _ in words], "odd": [o for _, _, o in words], "n": [n for _, n, _ in words]})

        for part in parts:
            for text in part["text"]:
                for t in text.split():
                    t = t.strip(_OUTER)
                    counts[t] = counts.get(t, 0) + 1
            if len(counts) > held:
                yield from rows()
                counts = {}
        yield from rows()

    counts = keep(units.select(F.col("u.text").alias("text")).mapInPandas(run, "w string, odd boolean, n bigint").groupBy("w", "odd").agg(F.sum("n").alias("n")))
    total = counts.where("NOT odd").agg(F.sum("n")).first()[0] or 0
    least = max(LEXICON_LEAST, int(total * LEXICON_SHARE))
    words = {r["w"]: r["n"] for r in counts.where((F.col("n") >= least) & ~F.col("odd")).collect()}
    return words, least, counts


def odd_word(w: str) -> bool:
    """A word with signs or digits that no word has."""
    letters, digits = sum(c.isalpha() for c in w), sum(c.isdigit() for c in w)
    return len(w) > 2 and letters > digits and any(c.islower() for c in w) and (digits > 0 or any(c in ODD for c in w)) and not _MAIL.fullmatch(w)


def rare_words(counts: DataFrame, sent) -> DataFrame:
    """(w, right): the misread words below the lexicon with their right forms.

    Exact, whatever the size of the corpus: a word's own count is taken from all counts, and the forms it may stand for are looked up in the
    lexicon and, where they may be below it too, by a join with all counts. Only words below the lexicon are shuffled."""
    rare = counts.where(F.col("odd") | (F.col("n") < sent.value[2]))
    lower = counts.where("NOT odd").select(F.col("w").alias("lw"), F.col("n").alias("ln"))
    rare = rare.join(lower, (F.lower("w") == F.col("lw")) & (F.lower("w") != F.col("w")), "left").select("w", F.when(F.col("odd"), 1).otherwise(F.col("n") + F.coalesce("ln", F.lit(0))).alias("n"))

    def forms(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = ready(sent)
        for part in parts:
            out = []
            for w, n in part.itertuples(index=False):
                if len(w) < 2 or lexicon.count(w) or lexicon._nearest(w):
                    continue
                others: list[tuple[int, int, str]] = []
                found = lexicon._nearest(w, n, others)
                if found:
                    out.append((w, 0, 0, found, None, lexicon.count(found)))
                for depth, need, made in others:
                    keys = {made, made.lower()} if made[:1].isupper() and not made.isupper() else {made}
                    out += [(w, depth, need, made, key, 0) for key in keys]
            if out:
                yield pd.DataFrame(out, columns=["w", "depth", "need", "right", "key", "score"])

    made = rare.mapInPandas(forms, "w string, depth int, need bigint, right string, key string, score bigint")
    met = made.where("key IS NOT NULL").join(counts.where("NOT odd").select(F.col("w").alias("key"), "n"), "key").groupBy("w", "depth", "need", "right").agg(F.sum("n").alias("score")).where("score >= need")
    return made.where("key IS NULL").select("w", "depth", "right", "score").unionByName(met.select("w", "depth", "right", "score")).groupBy("w").agg(F.max_by("right", F.struct(-F.col("depth"), "score", "right")).alias("right"))


def rare_on_pages(units: DataFrame, rare: DataFrame, sent) -> DataFrame:
    """(unit_table, doc, page, alone, w, right): :func:`rare_words` on the pages they stand on; only words below the lexicon are shuffled."""

    def seen(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = ready(sent).counts
        for part in parts:
            rows = []
            for where, text in zip(part[["unit_table", "doc", "page", "alone"]].itertuples(index=False), part["text"]):
                page = None if pd.isna(where.page) else int(where.page)
                for t in {t.strip(_OUTER) for t in text.split()}:
                    if len(t) > 1 and t not in words and (_WORD.fullmatch(t) or odd_word(t)):
                        rows.append((where.unit_table, where.doc, page, where.alone, t))
            out = pd.DataFrame(rows, columns=["unit_table", "doc", "page", "alone", "w"])
            out["page"] = out["page"].astype("Int32")
            if rows:
                yield out

    scanned = units.where(~F.col("u.native") & ~F.col("u.table")).select("unit_table", "doc", "page", "alone", F.col("u.text").alias("text"))
    held = scanned.mapInPandas(seen, "unit_table string, doc string, page int, alone string, w string")
    return held.join(rare, "w").select("unit_table", "doc", "page", "alone", "w", "right").distinct()


PAGE = T.StructType([
    T.StructField("defects", T.ArrayType(T.StructType([T.StructField("id", T.LongType()), T.StructField("defect", T.StringType())]))),
    T.StructField("first", T.StructType([T.StructField("unit", T.LongType()), T.StructField("token", T.StringType()), T.StructField("native", T.BooleanType()), T.StructField("wrong", T.BooleanType())])),
    T.StructField("last", T.StructType([T.StructField("unit", T.LongType()), T.StructField("token", T.StringType()), T.StructField("native", T.BooleanType())])),
    T.StructField("paragraphs", T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("open", T.BooleanType()), T.StructField("done", T.BooleanType()), T.StructField("head", T.StringType()), T.StructField("no", T.IntegerType())]))),
    T.StructField("others", T.ArrayType(T.StructType([T.StructField("no", T.IntegerType()), T.StructField("text", T.StringType())]))),
])

_READY: dict[str, Lexicon] = {}


class Reader:
    """Reads the pages of scanned documents and PDF files; holds the lexicon of their words."""

    def __init__(self, lines: DataFrame | None, blocks: DataFrame | None):
        units = units_of(lines, blocks)
        self.spark = units.sparkSession
        ship(self.spark)
        words, least, counts = build_lexicon(units)
        doubts = learn_doubts(units)
        longest = counts.where("NOT odd").agg(F.max(F.length("w"))).first()[0] or 0
        self.lexicon = self.spark.sparkContext.broadcast((uuid4().hex, words, least, None, doubts, longest))
        marks = repeated_keys(units).select("unit_table", "doc", "page", F.lit(None).cast("string").alias("alone"), F.struct(
            F.lit(None).cast("int").alias("no"), F.lit(None).cast("bigint").alias("id"), F.col("key").alias("text"), F.col("n").cast("double").alias("conf"), *[F.lit(None).cast("double").alias(c) for c in "yhxw"], F.lit(False).alias("table"), F.lit(False).alias("native")).alias("u"))
        rare = keep(rare_words(counts, self.lexicon))
        held = {r["w"]: r["right"] for r in rare.limit(RARE_SENT + 1).collect()}
        units = units.unionByName(marks)
        if len(held) > RARE_SENT:
            units = units.unionByName(rare_on_pages(units.where("u.id IS NOT NULL"), rare, self.lexicon).select("unit_table", "doc", "page", "alone", F.struct(
                F.lit(1).alias("no"), F.lit(None).cast("bigint").alias("id"), F.concat("w", F.lit("\t"), "right").alias("text"), F.lit(None).cast("double").alias("conf"), *[F.lit(None).cast("double").alias(c) for c in "yhxw"], F.lit(False).alias("table"), F.lit(False).alias("native")).alias("u")))
        elif held:
            self.lexicon = self.spark.sparkContext.broadcast((uuid4().hex, words, least, held, doubts, longest))
        pages = units.groupBy("unit_table", "doc", "page", "alone").agg(F.collect_set("u").alias("units"))
        self.pages = pages.select("unit_table", "doc", "page", self._read()(F.col("page"), F.col("units")).alias("r"))

    def _read(self):
        sent = self.lexicon

        @F.pandas_udf(PAGE)
        def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
            lexicon = ready(sent)
            for numbers, pages in parts:
                rows = []
                for number, raw in zip(numbers, pages):
                    number = None if number is None or number != number else int(number)
                    repeated = {u["text"]: int(u["conf"]) for u in raw if u["id"] is None and u["no"] is None}
                    rare = dict(u["text"].split("\t") for u in raw if u["id"] is None and u["no"] is not None)
                    units, seen = [], set()
                    for u in sorted((u for u in raw if u["id"] is not None), key=lambda u: (u["no"] is None, u["no"] or 0, u["id"])):
                        if u["id"] not in seen:
                            seen.add(u["id"])
                            units.append(Unit(u["id"], u["text"], u["conf"], u["y"], u["h"] or 0.0, u["x"] or 0.0, u["w"] or 0.0, u["table"], u["native"]))
                    got = read_page(units, lexicon, number, repeated, rare)
                    rows.append({
                        "defects": [{"id": u.id, "defect": d} for u in units for d in sorted(u.defects)],
                        "first": got["first"] and {k: got["first"][k] for k in ("unit", "token", "native", "wrong")},
                        "last": got["last"],
                        "paragraphs": [{k: p[k] for k in ("text", "open", "done", "head", "no")} for p in got["paragraphs"]],
                        "others": got["others"],
                    })
                yield pd.DataFrame(rows, columns=["defects", "first", "last", "paragraphs", "others"])

        return run

    def defects(self) -> DataFrame:
        """(unit_table, unit_id, defect) of every unit with a defect.

        One shuffle brings the units of a page together; another, of one narrow row a page, the cut word at a page's end and the first word of
        the next. Repeated rows count once. Units without id are left out, units without document or page are read on their own; null
        texts have no defect; a null confidence counts for nothing, others as :func:`learn_doubts` finds."""
        pages = keep(self.pages.select("unit_table", "doc", "page", "r.defects", "r.first", "r.last"))
        within = pages.select("unit_table", F.explode("defects").alias("d")).select("unit_table", F.col("d.id").alias("unit_id"), "d.defect")
        lefts = pages.where(F.col("last").isNotNull()).select("unit_table", "doc", (F.col("page") + 1).alias("page"), F.col("last.unit").alias("left_unit"), F.col("last.token").alias("left"), F.col("last.native").alias("left_native"))
        rights = pages.where(F.col("first").isNotNull()).select("unit_table", "doc", "page", F.col("first.unit").alias("right_unit"), F.col("first.token").alias("right"), F.col("first.native").alias("right_native"), F.col("first.wrong").alias("right_wrong"))
        sent = self.lexicon

        @F.pandas_udf("struct<hyphen:boolean,left:boolean,right:boolean>")
        def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
            lexicon = ready(sent)
            for a, b in parts:
                yield pd.DataFrame([bridge(x if isinstance(x, str) else None, y if isinstance(y, str) else None, lexicon) for x, y in zip(a, b)], columns=["hyphen", "left", "right"])

        met = lefts.join(rights, ["unit_table", "doc", "page"], "full").withColumn("b", run("left", "right"))
        across = met.select("unit_table", F.explode(F.array(
            F.when(F.col("b.hyphen"), F.struct(F.col("left_unit").alias("unit_id"), F.lit("hyphen").alias("defect"))),
            F.when(F.col("b.left") & ~F.col("left_native"), F.struct(F.col("left_unit").alias("unit_id"), F.lit("misread").alias("defect"))),
            F.when((F.col("b.right") | F.col("right_wrong") & ~F.coalesce("b.hyphen", F.lit(False))) & ~F.col("right_native"), F.struct(F.col("right_unit").alias("unit_id"), F.lit("misread").alias("defect"))))).alias("x")).where(F.col("x").isNotNull()).select("unit_table", "x.unit_id", "x.defect")
        return within.unionByName(across).distinct()

    def paragraphs(self) -> DataFrame:
        """(unit_table, document_id, page_number, paragraph_no, pages, text): the running text in paragraphs, and titles and tables as paragraphs of their own.

        A paragraph that its page leaves open goes on in the first of the next page when that does not start a new one. The page where each
        open paragraph began is carried forward in two steps, within spans of 256 pages and over the spans, in narrow rows, so no task gets
        all pages of a long document; only paragraphs at pages' edges are shuffled again, and the parts of one brought together."""
        # kept before the filter, which would otherwise read every page again
        read = keep(self.pages.select("unit_table", "doc", "page", "r.paragraphs", "r.others"))
        pages = read.where(F.size("paragraphs") > 0).drop("others")
        others = read.select("unit_table", "doc", "page", F.explode("others").alias("o"))
        narrow = pages.select("unit_table", "doc", "page", F.get("paragraphs", F.lit(0))["open"].alias("goes_on"), F.get("paragraphs", F.size("paragraphs") - 1)["done"].alias("done"), F.size("paragraphs").alias("k"))
        before = narrow.select("unit_table", "doc", (F.col("page") + 1).alias("page"), (~F.col("done")).alias("was_open"))
        flags = narrow.join(before, ["unit_table", "doc", "page"], "left").withColumn("goes_on", F.col("goes_on") & F.coalesce("was_open", F.lit(False)))
        flags = flags.withColumn("span", F.floor(F.col("page") / 256)).withColumn("head", F.when(~F.col("goes_on") | (F.col("k") > 1), F.col("page")))
        in_span = Window.partitionBy("unit_table", "doc", "span").orderBy("page")
        flags = flags.withColumn("local", F.last("head", ignorenulls=True).over(in_span))
        spans = flags.groupBy("unit_table", "doc", "span").agg(F.max("local").alias("end_head"))
        carried = spans.withColumn("carry", F.last("end_head", ignorenulls=True).over(Window.partitionBy("unit_table", "doc").orderBy("span").rowsBetween(Window.unboundedPreceding, -1))).select("unit_table", "doc", "span", "carry")
        flags = flags.join(carried, ["unit_table", "doc", "span"], "left")
        prior = F.coalesce(F.lag("local").over(in_span), F.col("carry"))
        flags = flags.withColumn("from", F.when(F.col("goes_on"), prior)).select("unit_table", "doc", "page", "from")
        each = pages.select("unit_table", "doc", "page", F.posexplode("paragraphs").alias("pos", "p"), F.size("paragraphs").alias("k"))
        # only a page's first paragraph, where it is open, and its last one may be parts of others; the rest are whole and not shuffled again
        loose = ((F.col("pos") == 0) & F.col("p.open")) | (F.col("pos") == F.col("k") - 1)
        parts = (each.where(loose).join(flags, ["unit_table", "doc", "page"], "left")
                 .select("unit_table", "doc", F.when((F.col("pos") == 0) & F.col("from").isNotNull(), F.col("from")).otherwise(F.col("page")).alias("start"),
                         F.when((F.col("pos") == 0) & F.col("from").isNotNull(), F.lit(-1)).when(F.col("pos") == F.col("k") - 1, F.lit(-1)).otherwise(F.col("p.no")).alias("no"), "page", "p.text", "p.head", F.col("p.no").alias("own")))
        after_first = F.regexp_replace("p.text", r"^[^ ]* ?", "")
        right = F.when(F.col("p.head").isNull(), F.col("p.text")).when(after_first == "", F.col("p.head")).otherwise(F.concat_ws(" ", "p.head", after_first))
        closed = each.where(~loose).select("unit_table", "doc", F.col("page").alias("page_number"), F.col("p.no").cast("bigint").alias("paragraph_no"), F.lit(1).cast("bigint").alias("pages"), right.alias("text"))
        sent = self.lexicon

        @F.pandas_udf("string")
        def join(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            lexicon = ready(sent)
            for series in parts:
                out = []
                for pieces in series:
                    text = ""
                    for piece, head in ((p["text"], p["head"]) for p in sorted(pieces, key=lambda p: p["page"] if p["page"] is not None else -1)):
                        left = ends_hyphen(text) if text else None
                        first, _, rest = piece.partition(" ")
                        if left and piece and not first[0].isdigit():
                            word = left[:-1] + first if lexicon.cut(left, first) else left + first
                            text = text.rstrip()[: -len(left)] + lexicon.judge(word)[1] + (" " + rest if rest else "")
                        else:
                            if head is not None:
                                piece = head + (" " + rest if rest else "")
                            text += (" " if text and piece else "") + piece
                    out.append(text)
                yield pd.Series(out)

        whole = parts.groupBy("unit_table", "doc", "start", "no").agg(F.collect_list(F.struct("page", "text", "head")).alias("pieces"), F.min_by("own", "page").alias("own"))
        document = F.when(~F.col("doc").startswith("\x00"), F.col("doc")).alias("document_id")
        apart = others.select("unit_table", document, F.col("page").alias("page_number"), F.col("o.no").cast("bigint").alias("paragraph_no"), F.lit(1).cast("bigint").alias("pages"), F.col("o.text").alias("text"))
        return whole.select("unit_table", document, F.col("start").alias("page_number"), F.coalesce("own", "no").cast("bigint").alias("paragraph_no"),
                            F.size("pieces").cast("bigint").alias("pages"), join("pieces").alias("text")).unionByName(apart).unionByName(closed.withColumn("document_id", document).drop("doc"))


def ready(sent) -> Lexicon:
    """The lexicon of a broadcast, built once in a process."""
    name, *held = sent.value
    if name not in _READY:
        _READY.clear()
        _READY[name] = Lexicon(*held)
    return _READY[name]
