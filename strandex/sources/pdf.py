"""Text of PDF files: the words that content streams show, at their places, by the published format. Scanned pages have none."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

from ..operators.geometry import Box, group_paragraphs, reading_order

#: Width of a character where its font names none, and the gap that parts words, in parts of the font's size.
USUAL_WIDTH, WORD_GAP = 0.5, 0.2
_SPACE = b"\0\t\n\f\r "
_DELIMITERS = b"()<>[]{}/%"
_OBJECT = re.compile(rb"(?<!\d)(\d{1,10})\s+(\d{1,5})\s+obj\b")
_NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)")


class Name(str):
    """A name object."""


class Word(str):
    """An operator or keyword."""


@dataclass(frozen=True)
class Ref:
    number: int


@dataclass
class Stream:
    head: dict
    raw: bytes


class Tokens:
    """Objects of a piece of PDF syntax, one after the other."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def _skip(self) -> None:
        d, n = self.data, len(self.data)
        while self.at < n:
            c = d[self.at]
            if c in _SPACE:
                self.at += 1
            elif c == 0x25:
                while self.at < n and d[self.at] not in b"\r\n":
                    self.at += 1
            else:
                return

    def next(self):
        """The next object, or None at the end. Closing brackets come as words."""
        self._skip()
        d, at = self.data, self.at
        if at >= len(d):
            return None
        c = d[at : at + 1]
        if c == b"/":
            end = at + 1
            while end < len(d) and d[end] not in _SPACE and d[end] not in _DELIMITERS:
                end += 1
            self.at = end
            return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), d[at + 1 : end]).decode("latin-1"))
        if c == b"(":
            return self._string()
        if d[at : at + 2] in (b"<<", b">>"):
            self.at += 2
            return self._dictionary() if c == b"<" else Word(">>")
        if c == b"<":
            end = d.find(b">", at)
            self.at = len(d) if end < 0 else end + 1
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", d[at + 1 : end if end >= 0 else len(d)])
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if c in (b"[", b"]", b"{", b"}", b")", b">"):
            self.at += 1
            return self._array() if c == b"[" else Word(c.decode())
        m = _NUMBER.match(d, at)
        if m:
            self.at = m.end()
            if m[0].isdigit():
                r = re.compile(rb"\s+(\d{1,5})\s+R(?![^\s()<>\[\]{}/%])").match(d, self.at)
                if r:
                    self.at = r.end()
                    return Ref(int(m[0]))
                return int(m[0])
            return float(m[0])
        end = at + 1
        while end < len(d) and d[end] not in _SPACE and d[end] not in _DELIMITERS:
            end += 1
        self.at = end
        word = d[at:end].decode("latin-1")
        return {"true": True, "false": False}.get(word, Word(word))

    def _string(self) -> bytes:
        d, out, depth, i = self.data, bytearray(), 1, self.at + 1
        plain = {0x6E: 10, 0x72: 13, 0x74: 9, 0x62: 8, 0x66: 12}
        while i < len(d):
            c = d[i]
            if c == 0x5C and i + 1 < len(d):
                i += 1
                c = d[i]
                octal = re.compile(rb"[0-7]{1,3}").match(d, i)
                if octal:
                    out.append(int(octal[0], 8) & 255)
                    i = octal.end()
                    continue
                if c == 13 and d[i + 1 : i + 2] == b"\n":
                    i += 1
                if c not in (10, 13):
                    out.append(plain.get(c, c))
            elif c in (0x28, 0x29):
                depth += 1 if c == 0x28 else -1
                if not depth:
                    self.at = i + 1
                    return bytes(out)
                out.append(c)
            else:
                out.append(c)
            i += 1
        self.at = len(d)
        return bytes(out)

    def _array(self) -> list:
        out: list = []
        while (x := self.next()) is not None and not (isinstance(x, Word) and x == "]"):
            out.append(None if isinstance(x, Word) and x == "null" else x)
        return out

    def _dictionary(self) -> dict:
        out: dict = {}
        while (key := self.next()) is not None and not (isinstance(key, Word) and key == ">>"):
            value = self.next()
            if isinstance(value, Word) and value == ">>":
                break
            if isinstance(key, Name) and not (isinstance(value, Word) and value == "null"):
                out[str(key)] = value
        return out


class Document:
    """The objects of a file, found by their headings, so that broken tables of places do no harm; of several of one number the last counts."""

    def __init__(self, data: bytes):
        if b"%PDF-" not in data[:1024]:
            raise ValueError("no PDF file")
        self.objects: dict[int, object] = {}
        trailers = [Tokens(data, m.end()).next() for m in re.finditer(rb"\btrailer\b", data)]
        for m in _OBJECT.finditer(data):
            t = Tokens(data, m.end())
            value = t.next()
            if isinstance(value, dict):
                t._skip()
                if data.startswith(b"stream", t.at):
                    start = t.at + 6
                    start += 2 if data[start : start + 2] == b"\r\n" else 1
                    size = value.get("Length")
                    end = start + size if isinstance(size, int) and data[start + size : start + size + 20].lstrip().startswith(b"endstream") else data.find(b"endstream", start)
                    value = Stream(value, data[start : end if end >= 0 else len(data)])
                    if value.head.get("Type") == "XRef":
                        trailers.append(value.head)
            self.objects[int(m[1])] = value
        heads = [t for t in trailers if isinstance(t, dict)]
        if any("Encrypt" in t for t in heads):
            raise PermissionError("encrypted")
        for s in [x for x in self.objects.values() if isinstance(x, Stream) and x.head.get("Type") == "ObjStm"]:
            body = self.bytes_of(s)
            first, n = self.get(s.head, "First"), self.get(s.head, "N")
            places = Tokens(body)
            for _ in range(n if isinstance(n, int) else 0):
                number, offset = places.next(), places.next()
                if isinstance(number, int) and isinstance(offset, int) and isinstance(first, int) and number not in self.objects:
                    self.objects[number] = Tokens(body, first + offset).next()
        self.root = next((r for t in reversed(heads) if isinstance(r := self.get(t, "Root"), dict)), None) or next((x for x in self.objects.values() if isinstance(x, dict) and x.get("Type") == "Catalog"), {})

    def value(self, x):
        for _ in range(32):
            if not isinstance(x, Ref):
                return x
            x = self.objects.get(x.number)
        return None

    def get(self, of, key: str):
        return self.value(of.get(key)) if isinstance(of, dict) else None

    def bytes_of(self, s: Stream) -> bytes:
        """A stream's bytes without its filters; unknown filters give nothing."""
        filters, out = self.get(s.head, "Filter"), s.raw
        options = self.get(s.head, "DecodeParms")
        for k, f in enumerate(filters if isinstance(filters, list) else [filters] if filters else []):
            f = self.value(f)
            if f in ("FlateDecode", "Fl"):
                d = zlib.decompressobj()
                try:
                    out = d.decompress(out) + d.flush()
                except zlib.error:
                    return b""
                o = self.value(options[k]) if isinstance(options, list) and k < len(options) else options
                if isinstance(o, dict) and (self.get(o, "Predictor") or 1) >= 10:
                    out = _unfiltered(out, (self.get(o, "Columns") or 1) * (self.get(o, "Colors") or 1))
            elif f in ("ASCIIHexDecode", "AHx"):
                digits = re.sub(rb"[^0-9A-Fa-f]", b"", out.partition(b">")[0])
                out = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
            else:
                return b""
        return out

    def pages(self) -> Iterator[dict]:
        """Pages in order, with what they inherit."""
        seen: set[int] = set()

        def walk(node, held: dict) -> Iterator[dict]:
            node = self.value(node)
            if not isinstance(node, dict) or id(node) in seen:
                return
            seen.add(id(node))
            held = held | {k: node[k] for k in ("Resources", "MediaBox", "CropBox", "Rotate") if k in node}
            kids = self.get(node, "Kids")
            if isinstance(kids, list):
                for kid in kids:
                    yield from walk(kid, held)
            else:
                yield held | node

        yield from walk(self.root.get("Pages"), {})


def _unfiltered(data: bytes, width: int) -> bytes:
    """Rows of bytes whose differences were stored, by the first byte of each row."""
    out, above = bytearray(), bytes(width)
    for at in range(0, len(data), width + 1):
        kind, row = data[at], bytearray(data[at + 1 : at + 1 + width])
        for i, x in enumerate(row):
            left, up, corner = row[i - 1] if i else 0, above[i] if i < len(above) else 0, above[i - 1] if i else 0
            if kind == 4:
                p = left + up - corner
                guess = min((left, up, corner), key=lambda v: abs(p - v))
            else:
                guess = (0, left, up, (left + up) // 2)[kind] if kind < 4 else 0
            row[i] = (x + guess) & 255
        out += row
        above = bytes(row)
    return bytes(out)


@dataclass
class Font:
    """How a font's codes are read: their length, characters and widths in parts of the size."""

    two: bool = False
    chars: dict[int, str] = field(default_factory=dict)
    widths: dict[int, float] = field(default_factory=dict)
    usual: float = USUAL_WIDTH
    bold: bool = False

    def read(self, text: bytes) -> Iterator[tuple[str, float, bool]]:
        """(characters, width, whether a single blank code) of each code."""
        codes = [int.from_bytes(text[i : i + 2], "big") for i in range(0, len(text) - 1, 2)] if self.two else text
        for c in codes:
            shown = self.chars.get(c)
            if shown is None:
                shown = bytes([c]).decode("cp1252", "replace") if not self.two and c >= 32 else ""
            yield shown, self.widths.get(c, self.usual), not self.two and c == 32


def load_font(doc: Document, f) -> Font:
    out = Font(bold="bold" in str(doc.get(f, "BaseFont") or "").lower())
    inner = (doc.get(f, "DescendantFonts") or [None])[0] if doc.get(f, "Subtype") == "Type0" else None
    if inner is not None:
        inner = doc.value(inner)
        out.two, out.usual = True, (doc.get(inner, "DW") or 1000) / 1000
        w = [doc.value(x) for x in doc.get(inner, "W") or []]
        i = 0
        while i + 1 < len(w):
            if isinstance(w[i + 1], list):
                out.widths |= {w[i] + k: doc.value(x) / 1000 for k, x in enumerate(w[i + 1])}
                i += 2
            else:
                if i + 2 < len(w) and w[i + 1] - w[i] <= 0xFFFF:
                    out.widths |= {c: w[i + 2] / 1000 for c in range(w[i], w[i + 1] + 1)}
                i += 3
    else:
        first = doc.get(f, "FirstChar") or 0
        out.widths = {first + k: x / 1000 for k, x in enumerate(map(doc.value, doc.get(f, "Widths") or [])) if isinstance(x, (int, float))}
        encoding = doc.get(f, "Encoding")
        if encoding == "MacRomanEncoding" or doc.get(encoding, "BaseEncoding") == "MacRomanEncoding":
            out.chars = {c: bytes([c]).decode("mac-roman") for c in range(32, 256)}
        at = 0
        for x in doc.get(encoding, "Differences") or []:
            if isinstance(x, int):
                at = x
            else:
                if shown := _glyph(str(x)):
                    out.chars[at] = shown
                at += 1
    names = doc.get(f, "ToUnicode")
    if isinstance(names, Stream):
        out.chars |= _unicode_map(doc.bytes_of(names))
    return out


def _glyph(name: str) -> str | None:
    """The character of a glyph's name where the name tells it: letters, ``uniXXXX`` and the names of Unicode in the short form of fonts."""
    import unicodedata

    if len(name) == 1:
        return name
    if m := re.fullmatch(r"uni([0-9A-F]{4})|u([0-9A-F]{4,6})", name):
        return chr(int(m[1] or m[2], 16))
    if m := re.fullmatch(r"([A-Za-z])(acute|grave|circumflex|dieresis|tilde|ring|cedilla|caron)", name):
        mark = {"circumflex": "CIRCUMFLEX", "dieresis": "DIAERESIS", "ring": "RING ABOVE"}.get(m[2], m[2].upper())
        try:
            return unicodedata.lookup(f"LATIN {'CAPITAL' if m[1].isupper() else 'SMALL'} LETTER {m[1].upper()} WITH {mark}")
        except KeyError:
            return None
    simple = {"space": " ", "hyphen": "-", "period": ".", "comma": ",", "colon": ":", "semicolon": ";", "fi": "fi", "fl": "fl", "ff": "ff", "ffi": "ffi", "quoteright": "’", "quoteleft": "‘", "quotedblleft": "“", "quotedblright": "”", "endash": "–", "emdash": "—", "bullet": "•", "germandbls": "ß",
              "parenleft": "(", "parenright": ")", "slash": "/", "percent": "%"} | dict(zip("zero one two three four five six seven eight nine".split(), "0123456789"))
    return simple.get(name)


def _unicode_map(data: bytes) -> dict[int, str]:
    """Codes and their characters from the map that a font carries."""
    out: dict[int, str] = {}
    t, held = Tokens(data), []
    shown = lambda b: b.decode("utf-16-be", "replace")
    while (x := t.next()) is not None:
        if isinstance(x, Word) and x in ("beginbfchar", "beginbfrange"):
            held = []
        elif isinstance(x, Word) and x == "endbfchar":
            for a, b in zip(held[::2], held[1::2]):
                if isinstance(a, bytes) and isinstance(b, bytes):
                    out[int.from_bytes(a, "big")] = shown(b)
        elif isinstance(x, Word) and x == "endbfrange":
            for a, b, c in zip(held[::3], held[1::3], held[2::3]):
                low, high = int.from_bytes(a, "big"), int.from_bytes(b, "big")
                for k in range(low, min(high, low + 0xFFFF) + 1):
                    if isinstance(c, list):
                        if k - low < len(c):
                            out[k] = shown(c[k - low])
                    elif len(c) >= 2:
                        out[k] = shown(c[:-2] + struct.pack(">H", (int.from_bytes(c[-2:], "big") + k - low) & 0xFFFF))
        else:
            held.append(x)
    return out


@dataclass
class Run:
    """Characters shown together: text, place of their base line in the page's units, width and size."""

    text: str
    x: float
    y: float
    width: float
    size: float
    bold: bool


def _times(a: tuple, b: tuple) -> tuple:
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


ONE = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def runs_of(doc: Document, content: bytes, resources, fonts: dict[int, Font], base: tuple = ONE, depth: int = 0) -> Iterator[Run]:
    """The texts that a content stream shows, with those of the forms it draws."""
    t, args, stack = Tokens(content), [], []
    place, font, size, leading, char, word, wide, rise = base, Font(), 1.0, 0.0, 0.0, 0.0, 1.0, 0.0
    text = line = ONE

    def show(s: bytes) -> Iterator[Run]:
        nonlocal text
        m = _times((size * wide, 0.0, 0.0, size, 0.0, rise), _times(text, place))
        out, moved = "", 0.0
        for shown, width, blank in font.read(s):
            out += shown
            moved += (width * size + char + (word if blank else 0.0)) * wide
        text = _times((1.0, 0.0, 0.0, 1.0, moved, 0.0), text)
        end = _times(text, place)
        if out.strip() and abs(m[3]) >= abs(m[1]):  # upright text
            yield Run(out, min(m[4], end[4]), m[5], abs(end[4] - m[4]), abs(m[3]) or 1.0, font.bold)

    while (x := t.next()) is not None:
        if not isinstance(x, Word):
            args.append(x)
            continue
        n = [a for a in args if isinstance(a, (int, float))]
        if x == "q":
            stack.append((place, font, size, leading, char, word, wide, rise))
        elif x == "Q" and stack:
            place, font, size, leading, char, word, wide, rise = stack.pop()
        elif x == "cm" and len(n) == 6:
            place = _times(tuple(n), place)
        elif x == "BT":
            text = line = ONE
        elif x == "Tf" and n and isinstance(args[0], Name):
            f = doc.get(doc.get(resources, "Font"), args[0])
            font, size = fonts.setdefault(id(f), load_font(doc, f)) if isinstance(f, dict) and id(f) not in fonts else fonts.get(id(f), Font()), float(n[-1])
        elif x == "TL" and n:
            leading = n[0]
        elif x == "Tc" and n:
            char = n[0]
        elif x == "Tw" and n:
            word = n[0]
        elif x == "Tz" and n:
            wide = n[0] / 100
        elif x == "Ts" and n:
            rise = n[0]
        elif x in ("Td", "TD") and len(n) == 2:
            leading = -n[1] if x == "TD" else leading
            text = line = _times((1.0, 0.0, 0.0, 1.0, n[0], n[1]), line)
        elif x == "Tm" and len(n) == 6:
            text = line = tuple(map(float, n))
        elif x in ("T*", "'", '"'):
            if x == '"' and len(n) == 2:
                word, char = n
            text = line = _times((1.0, 0.0, 0.0, 1.0, 0.0, -leading), line)
            if x != "T*" and args and isinstance(args[-1], bytes):
                yield from show(args[-1])
        elif x == "Tj" and args and isinstance(args[-1], bytes):
            yield from show(args[-1])
        elif x == "TJ" and args and isinstance(args[-1], list):
            for part in args[-1]:
                if isinstance(part, bytes):
                    yield from show(part)
                elif isinstance(part, (int, float)):
                    text = _times((1.0, 0.0, 0.0, 1.0, -part / 1000 * size * wide, 0.0), text)
        elif x == "Do" and args and isinstance(args[-1], Name) and depth < 8:
            form = doc.get(doc.get(resources, "XObject"), args[-1])
            if isinstance(form, Stream) and form.head.get("Subtype") == "Form":
                own = doc.get(form.head, "Matrix")
                yield from runs_of(doc, doc.bytes_of(form), doc.get(form.head, "Resources") or resources, fonts, _times(tuple(own), place) if isinstance(own, list) and len(own) == 6 else place, depth + 1)
        elif x == "BI":  # an image inside the stream
            end = re.compile(rb"\sEI(?=\s|$)").search(content, t.at)
            t.at = end.end() if end else len(content)
        args = []


def lines_of(runs: list[Run]) -> list[Run]:
    """Runs of one base line and size joined from left to right, with a blank where they stand apart by more than a part of the size; columns stay
    apart where the gap is wider than two characters' height."""
    out: list[Run] = []
    for r in sorted(runs, key=lambda r: (-round(r.y, 1), r.x)):
        last = out[-1] if out else None
        if last and abs(last.y - r.y) <= 0.3 * min(last.size, r.size):
            gap = r.x - last.x - last.width
            if -0.5 * r.size <= gap <= 2 * r.size:
                blank = " " if gap > WORD_GAP * r.size and not last.text.endswith(" ") and not r.text.startswith(" ") else ""
                out[-1] = Run(last.text + blank + r.text, last.x, last.y, max(last.width, r.x + r.width - last.x), max(last.size, r.size), last.bold and r.bold)
                continue
        out.append(r)
    return out


def pdf_pages(data: bytes) -> Iterator[tuple[int, list[Box]]]:
    """(page number from 1, its paragraphs in reading order) of a file. An encrypted file raises PermissionError, what is no PDF ValueError."""
    doc = Document(data)
    fonts: dict[int, Font] = {}
    for number, page in enumerate(doc.pages(), 1):
        box = [doc.value(v) for v in doc.get(page, "CropBox") or doc.get(page, "MediaBox") or [0, 0, 612, 792]]
        left, low, width, height = min(box[0], box[2]), min(box[1], box[3]), abs(box[2] - box[0]) or 1.0, abs(box[3] - box[1]) or 1.0
        parts = doc.get(page, "Contents")
        content = b"\n".join(doc.bytes_of(s) for p in (parts if isinstance(parts, list) else [parts]) if isinstance(s := doc.value(p), Stream))
        lines = lines_of(list(runs_of(doc, content, doc.get(page, "Resources"), fonts)))
        boxes = [Box(" ".join(r.text.split()), (r.x - left) / width, 1 - (r.y - low + 0.8 * r.size) / height, r.width / width, r.size / height) for r in lines]
        yield number, _paragraphs(reading_order([b for b in boxes if b.text]))


def _paragraphs(boxes: list[Box]) -> list[Box]:
    """Lines of native text joined as recognised ones are."""
    from dataclasses import replace

    return [replace(b, method="NativeText") for b in group_paragraphs([replace(b, method="Ocr") for b in boxes])]
