"""Splitting long texts at natural boundaries, by lexical cohesion, with an overlap."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship

#: Kinds of boundary, the coarsest first; the last means cutting inside a word.
KINDS = ("paragraph", "line", "sentence", "word", "none")
#: Words in each of the two blocks that slide over a gap.
BLOCK_WORDS = 60
#: The least new text in a piece, as a part of the limit, where the boundaries allow it.
LEAST = 0.4

_PARAGRAPH = re.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+")
_LINE = re.compile(r"\n")
_SENTENCE = re.compile(r"\n|(?<=[.!?…])[^\S\n]+(?=[^\W\d_])")
_WORD = re.compile(r"\s+")
_TOKEN = re.compile(r"[^\W\d_]{2,}")


def _upper_next(text: str, at: int) -> bool:
    return text[at].isupper() or text[at].istitle()


def separators(text: str, kind: str) -> list[tuple[int, int]]:
    """(start, end) of the separators of a kind; each kind's separators hold those of the coarser ones."""
    if kind == "paragraph":
        return [m.span() for m in _PARAGRAPH.finditer(text)]
    if kind == "line":
        return [m.span() for m in _LINE.finditer(text)]
    if kind == "sentence":
        return [m.span() for m in _SENTENCE.finditer(text) if m[0] == "\n" or _upper_next(text, m.end())]
    if kind == "word":
        return [m.span() for m in _WORD.finditer(text)]
    return []


def boundary(text: str, limit: int) -> tuple[str, list[tuple[int, int]]]:
    """The coarsest kind at which all parts are at most ``limit`` long, and its separators."""
    for kind in KINDS[:-1]:
        cuts = separators(text, kind)
        last, fits = 0, True
        for a, b in cuts:
            if a - last > limit:
                fits = False
                break
            last = b
        if fits and len(text) - last <= limit:
            return kind, cuts
    return "none", separators(text, "word")


def gap_depths(text: str, gaps: list[int], block: int = BLOCK_WORDS) -> list[float]:
    """Depth of the valley of lexical similarity at each gap: how far the cosine of the two blocks of words before and after a gap lies
    below the peaks reached by climbing to either side. A text's ends count as similarity 0. Gaps come in order; the time is linear in the text."""
    found = list(_TOKEN.finditer(text))
    starts = [m.start() for m in found]
    number: dict[str, int] = {}
    terms = [number.setdefault(m[0].casefold(), len(number)) for m in found]
    # counts of each word in the two blocks, with their dot product and squared lengths carried along: each word enters and leaves either block once
    left, right = [0] * len(number), [0] * len(number)
    dot = left_square = right_square = 0
    lo = mid = hi = 0
    scores = []
    for g in gaps:
        at = bisect_left(starts, g)
        a, b = max(0, at - block), min(len(terms), at + block)
        for t in terms[hi:b]:
            right_square += 2 * right[t] + 1
            right[t] += 1
            dot += left[t]
        for t in terms[mid:at]:
            right[t] -= 1
            right_square -= 2 * right[t] + 1
            dot -= left[t]
            left_square += 2 * left[t] + 1
            left[t] += 1
            dot += right[t]
        for t in terms[lo:a]:
            left[t] -= 1
            left_square -= 2 * left[t] + 1
            dot -= right[t]
        lo, mid, hi = a, at, b
        norm = (left_square * right_square) ** 0.5
        scores.append(dot / norm if norm else 0.0)
    peak_left, peak_right = scores[:], scores[:]
    for i in range(1, len(scores)):
        if peak_left[i - 1] >= scores[i]:
            peak_left[i] = peak_left[i - 1] if scores[i - 1] >= scores[i] else scores[i]
    for i in range(len(scores) - 2, -1, -1):
        if peak_right[i + 1] >= scores[i]:
            peak_right[i] = peak_right[i + 1] if scores[i + 1] >= scores[i] else scores[i]
    return [a + b - 2 * s for a, b, s in zip(peak_left, peak_right, scores)]


def split_text(text: str, limit: int = 2000, overlap: int = 200) -> tuple[str, list[tuple[int, int, int]]]:
    """The kind of boundary used and (start, own_start, end) of each piece: text[start:own_start] repeats the end of the piece before.

    Boundaries of the coarsest kind at which all parts fit are used only; where that is words or none, each window takes the coarsest kind that
    lies in it, and words only where no other does. From the start of a piece's own text the window of ends reaches
    from LEAST of the limit to the limit less the overlap (to the limit where no boundary lies in it); the deepest valley in it is cut, the
    later of equal ones. The overlap begins at a word where one begins nearby; it is shortened, never the own text, to keep to the limit.
    Pieces' own texts and the blanks between them make up the text again."""
    if len(text) <= limit:
        return KINDS[0], [(0, 0, len(text))] if text else []
    kind, cuts = boundary(text, limit)
    mixed = kind in ("word", "none")
    levels = []
    for cuts in [separators(text, k) for k in KINDS[:-1]] if mixed else [cuts]:
        cuts = [c for c in cuts if c[0] > 0]
        levels.append(([a for a, _ in cuts], [b for _, b in cuts], gap_depths(text, [b for _, b in cuts])))
    out: list[tuple[int, int, int]] = []
    own, used = 0, len(text.rstrip())
    while own < len(text):
        room = limit if not out else limit - overlap
        if len(text) - own <= room or used - own <= room:
            end = following = len(text)
        else:
            windows = ((own + int(LEAST * limit), own + room), (own + 1, own + room), (own + room + 1, own + limit))
            groups = [levels[:-1], levels[-1:]] if mixed else [levels]
            for low, high, (ends, nexts, depths) in ((low, high, level) for group in groups for low, high in windows for level in group):
                first, last = bisect_left(ends, low), bisect_right(ends, high)
                if first < last:
                    i = max(range(first, last), key=lambda k: (round(depths[k], 9), k))
                    end, following = ends[i], nexts[i]
                    break
            else:  # no boundary within the limit: a word longer than it
                end = following = own + room
        end = max(end, own + 1) if end <= own else end
        start = own
        if out:
            start = own - min(overlap, limit - (min(end, own + limit) - own), own)
            m = re.compile(r"(?<=\s)\S").search(text, start, min(own, start + overlap // 4)) if start and not text[start - 1].isspace() else None
            start = m.start() if m else start
        out.append((start, own, min(end, start + limit)))
        if end > start + limit:
            following = start + limit
        own = following
    return kind, out


PIECES = T.StructType([T.StructField("boundary", T.StringType()), T.StructField("pieces", T.ArrayType(T.StructType([
    T.StructField("piece_no", T.LongType()), T.StructField("start", T.LongType()), T.StructField("own_start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("text", T.StringType())])))])


def split_items(df: DataFrame, text_col: str, limit: int = 2000, overlap: int = 200) -> DataFrame:
    """df with a struct column ``split``: the boundary kind and the array of pieces of each text.

    Offsets are code points; ``own_start`` is where a piece's new text begins. A text within the limit is one piece, an empty text has none,
    a null text a null struct; repeated rows are split alike. A map over the rows, without a shuffle. limit must exceed twice the overlap."""
    if not 0 <= 2 * overlap < limit:
        raise ValueError("limit must exceed twice the overlap")
    ship(df.sparkSession)

    @F.pandas_udf(PIECES)
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in texts:
            kinds, lists = [], []
            for t in series:
                if t is None:
                    kinds.append(None), lists.append(None)
                    continue
                kind, pieces = split_text(t, limit, overlap)
                kinds.append(kind)
                lists.append([{"piece_no": k, "start": a, "own_start": o, "end": b, "text": t[a:b]} for k, (a, o, b) in enumerate(pieces)])
            yield pd.DataFrame({"boundary": kinds, "pieces": lists})

    split = run(F.col(text_col))
    return df.withColumn("split", F.when(F.col(text_col).isNotNull(), split))
