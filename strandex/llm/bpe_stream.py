"""Byte-level BPE as a streaming transducer with bounded look-ahead.

Every text is read in blocks of any size. Pre-tokens (runs of letters, digits, other signs or blanks) end once the characters that can still
change them have been seen; the tail of a block that may still change is held back. The bytes of each run go through
:class:`RunTransducer`, which emits tokens as soon as no continuation can change them; what it made of a short run is kept in a bounded memo.

The transducer rests on a property of merge lists: a token sequence is the encoding of its text exactly when each adjacent pair is the
encoding of the pair's text. So each prefix of a run has one possible last token, and a token boundary is stable when the chains of last
tokens from every prefix end that the next bytes can still build on pass through it. ``sufficient_lookahead`` bounds how many bytes that
takes for a merge list: the longest token times the longest chain of merges in which each merge can take the left part of the next away.
Boundaries with so many bytes behind them are emitted as they are, nearer ones when the chains show it, so no more than the bound is held.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain

import re

#: Characters read at a time.
BLOCK = 1 << 13
#: Characters of an unfinished pre-token that are held before its bytes go on to the transducer.
HELD = 1 << 10
#: Entries of the memo of runs and of that of pairs, which are emptied when full, and the longest run that is kept, in characters.
MEMO, KEPT = 400_000, 48


def byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte: itself where printable, else the next free letter from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    return out | {chr(256 + i): b for i, b in enumerate(rest)}


def _ranges(points: Iterable[int]) -> str:
    out, start, last = [], None, None
    for p in points:
        if start is None:
            start = last = p
        elif p == last + 1:
            last = p
        else:
            out.append((start, last))
            start = last = p
    if start is not None:
        out.append((start, last))
    return "".join(f"\\U{a:08x}" if a == b else f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


def _pattern() -> tuple[re.Pattern, re.Pattern, re.Pattern, re.Pattern]:
    """The pre-token pattern, and those of one letter, digit and blank. ``\\w`` minus decimal digits holds letters and the other numbers, so
    the other numbers are listed from the character data."""
    numbers = _ranges(c for c in range(128, sys.maxunicode + 1) if unicodedata.category(chr(c)) in ("Nl", "No"))
    blank = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
    letter, digit = f"[^\\W\\d_{numbers}]", f"[\\d{numbers}]"
    other = f"(?:[^\\w{blank}]|_)"
    whole = f"'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{digit}+| ?{other}+|[{blank}]+(?![^{blank}])|[{blank}]+"
    return re.compile(whole), re.compile(letter), re.compile(digit), re.compile(f"[{blank}]")


PIECES, LETTER, DIGIT, BLANK = _pattern()


class MergeList:
    """Tokens and merges of a byte-level BPE vocabulary."""

    def __init__(self, ids: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        self.ids = ids
        self.bytes_of = {i: b for b, i in ids.items()}
        self.merges = merges
        self.rank = {m: r for r, m in enumerate(merges)}
        self.longest = max((len(a) + len(b) for a, b in merges), default=1)
        self._pairs: dict[tuple[bytes, bytes], bool] = {}
        # tokens that are the encoding of their own bytes, and their lengths by last byte, the longest first
        self.whole = {t for t in ids if len(t) == 1 or self.merged(t) == (t,)}
        sizes: dict[int, set[int]] = {}
        for t in self.whole:
            sizes.setdefault(t[-1], set()).add(len(t))
        self.sizes = {end: tuple(sorted(found, reverse=True)) for end, found in sizes.items()}
        self.lookahead = self.sufficient_lookahead()

    @classmethod
    def load(cls, path: str) -> MergeList:
        """From a tokenizer file with ``model.vocab`` and ``model.merges``."""
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = byte_letters()
        raw = {t: bytes(letters[c] for c in t) for t in model["vocab"] if all(c in letters for c in t)}
        parts = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        merges = [(raw[a], raw[b]) for a, b in parts]
        made = {bytes([b]) for b in range(256)} | {a + b for a, b in merges}
        return cls({raw[t]: i for t, i in model["vocab"].items() if t in raw and raw[t] in made}, merges)

    def merged(self, data: bytes) -> tuple[bytes, ...]:
        """Tokens of the bytes of one or two tokens, by the merges themselves: the one of lowest rank first, the leftmost of equal ones first."""
        parts = [data[i : i + 1] for i in range(len(data))]
        rank = self.rank
        while len(parts) > 1:
            best, at = min(((rank.get(p, 1 << 30), i) for i, p in enumerate(zip(parts, parts[1:]))), default=(1 << 30, 0))
            if best == 1 << 30:
                break
            a, b = parts[at], parts[at + 1]
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and parts[i] == a and parts[i + 1] == b:
                    out.append(a + b)
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return tuple(parts)

    def adjacent(self, a: bytes, b: bytes) -> bool:
        """Whether the encoding of a + b is exactly a, b."""
        got = self._pairs.get((a, b))
        if got is None:
            if len(self._pairs) > MEMO:
                self._pairs.clear()
            got = self._pairs[a, b] = self.merged(a + b) == (a, b)
        return got

    def sufficient_lookahead(self) -> int:
        """A bound, in bytes, on how far a token boundary can depend on what follows.

        A later merge can undo a boundary only by taking the right part of an earlier token, whose merge then does not happen; such steps
        form a chain of merges of falling priority in which the right side of each starts the left side of the next. The bound is the
        length of the longest chain times the longest token."""
        by_start: dict[bytes, int] = {}
        best = 1
        for a, b in reversed(self.merges):
            ends = [b[i:] for i in range(len(b))]
            n = 1 + max((by_start.get(e, 0) for e in ends), default=0)
            start = a
            for i in range(1, len(start) + 1):
                if by_start.get(start[:i], 0) < n:
                    by_start[start[:i]] = n
            best = max(best, n)
        return best * self.longest


class RunTransducer:
    """Encodes one run byte by byte. ``feed`` returns the tokens that became stable, ``finish`` the rest.

    ``last[i]`` is the length of the last token of the prefix that ends at byte i. Only bytes behind the last emitted boundary are held: fewer
    than the merge list's look-ahead, one token and what one call of ``feed`` brings."""

    def __init__(self, merges: MergeList):
        self.m = merges
        self.data = b""
        self.last: list[int] = [0]
        self.before: bytes | None = None  # the token before the held bytes

    def feed(self, data: bytes) -> list[bytes]:
        m, last, whole = self.m, self.last, self.m.whole
        pairs, adjacent = m._pairs, m.adjacent
        n = len(self.data)
        held = self.data = self.data + data
        for value in data:
            n += 1
            for size in m.sizes[value]:
                at = n - size
                if at < 0:
                    continue
                token = held[at:n]
                if token not in whole:
                    continue
                left = held[at - last[at] : at] if at else self.before
                if left is None or (adjacent(left, token) if (left, token) not in pairs else pairs[left, token]):
                    last.append(size)
                    break
            else:
                raise AssertionError("a single byte always fits")
        return self._stable()

    def _stable(self) -> list[bytes]:
        """The tokens up to the last stable boundary: those with the look-ahead behind them, or on the chains of all the ends that a next token can begin at."""
        n = len(self.data)
        if n < 2 * self.m.longest:
            return []
        low = n - self.m.longest
        common: set[int] | None = None
        for end in range(low + 1, n + 1):
            cuts, i = set(), end
            while i:
                if common is None or i in common:
                    cuts.add(i)
                i -= self.last[i]
            common = cuts
            if not common:
                break
        if common:
            return self._take(max(common))
        if n <= self.m.lookahead:
            return []
        i = n
        while n - i < self.m.lookahead and i:
            i -= self.last[i]
        return self._take(i)

    def _take(self, upto: int) -> list[bytes]:
        out, i = [], upto
        while i:
            out.append(self.data[i - self.last[i] : i])
            i -= self.last[i]
        out.reverse()
        if out:
            self.before = out[-1]
            self.data = self.data[upto:]
            self.last = [0, *self.last[upto + 1 :]]
        return out

    def finish(self) -> list[bytes]:
        return self._take(len(self.data))


class _Memo(dict):
    """Ids of runs, made by the transducer when missing; short ones are kept, up to a bound."""

    def __init__(self, merges: MergeList):
        super().__init__()
        self.merges = merges

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids, run = self.merges.ids, RunTransducer(self.merges)
        data = piece.encode("utf-8", "surrogatepass")
        tokens = []
        for at in range(0, len(data), BLOCK):
            tokens += run.feed(data[at : at + BLOCK])
        got = tuple(ids[t] for t in tokens + run.finish())
        if len(piece) <= KEPT:
            if len(self) >= MEMO:
                self.clear()
            self[piece] = got
        return got


class Encoder:
    """Streaming encoder: ``stream`` takes the blocks of a text in order, ``encode`` and ``count`` a whole text, which they cut into blocks."""

    def __init__(self, merges: MergeList):
        self.merges = merges
        self.memo = _Memo(merges)

    def encode(self, text: str, block: int = 0) -> list[int]:
        return list(chain.from_iterable(self.stream(_blocks(text, block or BLOCK))))

    def count(self, text: str, block: int = 0) -> int:
        return sum(map(len, self.stream(_blocks(text, block or BLOCK))))

    def stream(self, blocks: Iterable[str]) -> Iterator[Sequence[int]]:
        """Ids, in short sequences, of the text that the blocks make up. Held back: the last two pre-tokens of what was read, or, of a run longer
        than HELD, what the transducer holds and one blank."""
        tail = ""
        run: tuple[re.Pattern, RunTransducer] | None = None
        memo, ids = self.memo, self.merges.ids
        for block in blocks:
            text = tail + block
            tail = ""
            if run:
                kind, open_run = run
                at = 0
                while at < len(text) and kind.match(text, at):
                    at += 1
                body, text = (text[:at], text[at:])
                if kind is BLANK:
                    # the last blank of a run belongs to what follows, if anything does
                    body, text = body[:-1], body[-1:] + text
                yield [ids[t] for t in open_run.feed(body.encode("utf-8", "surrogatepass"))]
                if not text or (kind is BLANK and len(text) == 1):
                    tail = text
                    continue
                yield [ids[t] for t in open_run.finish()]
                run = None
            pieces = PIECES.findall(text)
            held = pieces[-2:]
            yield from map(memo.__getitem__, pieces[:-2])
            tail = "".join(held)
            if held and len(held[-1]) > HELD:
                yield from map(memo.__getitem__, held[:-1])
                body = held[-1]
                kind = next((k for k in (LETTER, DIGIT, BLANK) if k.match(body, len(body) - 1)), OTHER)
                open_run = RunTransducer(self.merges)
                tail = body[-1] if kind is BLANK else ""
                yield [ids[t] for t in open_run.feed((body[:-1] if kind is BLANK else body).encode("utf-8", "surrogatepass"))]
                run = kind, open_run
        if run:
            kind, open_run = run
            yield [ids[t] for t in open_run.feed(tail.encode("utf-8", "surrogatepass")) + open_run.finish()]
            tail = ""
        yield from map(memo.__getitem__, PIECES.findall(tail))


def _blocks(text: str, size: int) -> Iterator[str]:
    return (text[i : i + size] for i in range(0, len(text), size))


class _Other:
    """Matches one character that is no letter, digit or blank."""

    @staticmethod
    def match(text: str, at: int = 0) -> bool:
        return at < len(text) and not (LETTER.match(text, at) or DIGIT.match(text, at) or BLANK.match(text, at))


OTHER = _Other()


class Decoder:
    """Incremental byte-to-text machine: ``feed`` takes one id and returns the characters completed by its bytes. Its state is the number of
    continuation bytes still due, the bits gathered and the range allowed for the next byte; a malformed sequence gives U+FFFD."""

    def __init__(self, merges: MergeList):
        self.bytes_of = merges.bytes_of
        self.due = 0
        self.bits = 0
        self.low, self.high = 0x80, 0xBF

    def feed(self, token: int) -> str:
        out = []
        for b in self.bytes_of[token]:
            if self.due:
                if self.low <= b <= self.high:
                    self.bits = self.bits << 6 | b & 0x3F
                    self.due -= 1
                    self.low, self.high = 0x80, 0xBF
                    if not self.due:
                        out.append(chr(self.bits))
                    continue
                out.append("�")
                self.due, self.low, self.high = 0, 0x80, 0xBF
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b <= 0xDF:
                self.due, self.bits = 1, b & 0x1F
            elif 0xE0 <= b <= 0xEF:
                self.due, self.bits = 2, b & 0x0F
                self.low, self.high = (0xA0 if b == 0xE0 else 0x80), (0x9F if b == 0xED else 0xBF)
            elif 0xF0 <= b <= 0xF4:
                self.due, self.bits = 3, b & 0x07
                self.low, self.high = (0x90 if b == 0xF0 else 0x80), (0x8F if b == 0xF4 else 0xBF)
            else:
                out.append("�")
        return "".join(out)

    def finish(self) -> str:
        held, self.due = self.due, 0
        return "�" if held else ""

    def decode(self, tokens: Iterable[int]) -> str:
        return "".join(map(self.feed, tokens)) + self.finish()


_LOADED: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file, loaded once in a process."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(MergeList.load(path))
    return _LOADED[path]
