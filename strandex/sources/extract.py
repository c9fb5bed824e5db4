"""Text and structure of files: a tree of contents, each with its blocks in order.

Everything a file holds is opened in one task: attachments, archive members and messages inside messages are followed to MAX_DEPTH, a file
that contains itself is stopped, and what cannot be read becomes an error row beside what can."""

from __future__ import annotations

import csv
import email
import email.policy
import gzip
import hashlib
import io
import json
import posixpath
import re
import struct
import tarfile
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field, replace
from datetime import datetime, timedelta
from html.parser import HTMLParser
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import for_display, for_search, spreadsheet_column
from ..operators.sections import Block
from .compound import outlook_mail
from .formats import decode, resolve
from .pdf import pdf_pages

MAX_DEPTH, MAX_ATTACHMENTS, MAX_ONE, MAX_TOTAL = 5, 1000, 250 << 20, 1 << 30
SPANS = "table_spans: merged cells retained; cell alignment is uncertain."


@dataclass
class Node:
    """A content: the file itself, or what is attached or packed in another."""

    name: str
    media_type: str | None = None
    relationship: str = "root"
    blocks: list[Block] = field(default_factory=list)
    children: list[Node] = field(default_factory=list)
    title: str | None = None
    status: str = "ready"


@dataclass
class Problem:
    code: str
    message: str
    component: str
    retryable: bool = False


class ExtractionError(Exception):
    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


class Headings:
    """The open headings of a document; each start closes those of its level and below, and begins a section of its own."""

    def __init__(self, prefix: str = "heading"):
        self.open: list[tuple[int, str]] = []
        self.count, self.prefix = 0, prefix

    def start(self, level: int, text: str) -> None:
        self.open = [h for h in self.open if h[0] < level] + [(level, for_display(text))]
        self.count += 1

    @property
    def fields(self) -> dict:
        path = tuple(t for _, t in self.open)
        return {"heading": path[-1] if path else None, "heading_path": path, "key": f"{self.prefix}:{self.count}" if self.count else "document"}


# HTML

_DROPPED = {"script", "style", "template", "noscript", "iframe", "object", "embed", "svg", "canvas"}
_FLOW = {"p", "div", "section", "article", "main", "aside", "nav", "header", "footer", "blockquote", "ul", "ol", "li", "pre", "figure", "figcaption", "dl", "dt", "dd", "hr"}
_INNER = {"p", "div", "section", "article", "li", "ul", "ol", "blockquote", "pre", "tr", "td", "th", "caption", "h1", "h2", "h3", "h4", "h5", "h6", "dt", "dd", "figcaption"}
_VOID = {"br", "img", "hr", "input", "meta", "link", "area", "base", "col", "source", "track", "wbr", "embed"}
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


class _Tree(HTMLParser):
    """A small element tree: (tag, attributes, children) with strings as text."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root: tuple = ("root", {}, [])
        self.stack = [self.root]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        while self.stack[-1][0] in _CLOSES.get(tag, ()):
            self.stack.pop()
        node: tuple = (tag, dict(attrs), [])
        self.stack[-1][2].append(node)
        if tag not in _VOID:
            self.stack.append(node)

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                return

    def handle_data(self, data: str) -> None:
        self.stack[-1][2].append(data)


def _find(node: tuple, tag: str) -> tuple | None:
    for c in node[2]:
        if isinstance(c, tuple):
            if c[0] == tag:
                return c
            got = _find(c, tag)
            if got:
                return got
    return None


def _inline(node: tuple) -> str:
    out = []
    for c in node[2]:
        if isinstance(c, str):
            out.append(c)
        elif c[0] == "br":
            out.append("\n")
        elif c[0] == "img":
            out.append(c[1].get("alt") or "")
        elif c[0] not in _DROPPED:
            edge = "\n" if c[0] in _INNER else ""
            out.append(edge + _inline(c) + edge)
    return "".join(out)


def _table_rows(node: tuple) -> list[tuple]:
    rows = []
    for c in node[2]:
        if isinstance(c, tuple) and c[0] != "table":
            rows += [c] if c[0] == "tr" else _table_rows(c)
    return rows


def html_blocks(text: str, base: Block | None = None, prefix: str = "") -> tuple[list[Block], str | None]:
    """(blocks, title): headings, paragraphs and tables in order. Navigation, headers and footers are boilerplate."""
    tree = _Tree()
    tree.feed(text)
    tree.close()
    base = base or Block("", kind="structure", method="Html")
    out: list[Block] = []
    heads = Headings()
    counts = {"block": 0, "table": 0}
    title = _find(tree.root, "title")

    def emit(raw: str, plain: bool, path: str | None = None, warning: str | None = None, table: bool = False) -> None:
        shown = raw if table else for_display(raw)
        if not shown.strip():
            return
        if path is None:
            counts["block"] += 1
            path = f"html/block[{counts['block']}]"
        out.append(replace(base, text=shown, path=prefix + path, warning=warning, boilerplate=plain, **heads.fields))

    def walk(node: tuple, plain: bool) -> None:
        held: list[str] = []

        def flush() -> None:
            emit("".join(held), plain)
            held.clear()

        for c in node[2]:
            if isinstance(c, str):
                held.append(c)
                continue
            tag = c[0]
            if tag == "br":
                held.append("\n")
            elif tag in _DROPPED or tag in ("head", "title"):
                continue
            elif re.fullmatch("h[1-6]", tag):
                flush()
                name = for_display(_inline(c))
                if name:
                    heads.start(int(tag[1]), name)
                    emit(name, plain)
            elif tag == "table":
                flush()
                counts["table"] += 1
                path = f"html/table[{counts['table']}]"
                for x in c[2]:
                    if isinstance(x, tuple) and x[0] == "caption":
                        emit(_inline(x), plain, path + "/caption")
                rows = [[x for x in r[2] if isinstance(x, tuple) and x[0] in ("td", "th")] for r in _table_rows(c)]
                spans = any((x[1].get(s) or "1") != "1" for r in rows for x in r for s in ("colspan", "rowspan"))
                emit("\n".join("\t".join(for_search(_inline(x)) for x in r) for r in rows), plain, path, SPANS if spans else None, True)
            elif tag in _FLOW:
                flush()
                walk(c, plain or tag in ("nav", "header", "footer"))
            elif tag == "img":
                held.append(c[1].get("alt") or "")
            elif tag in ("html", "body"):
                flush()
                walk(c, plain)
            else:
                held.append(_inline(c))
        flush()

    walk(_find(tree.root, "body") or tree.root, False)
    shown = for_display(_inline(title)) if title else ""
    return out, shown[:500] or None


def markdown_to_html(text: str) -> str:
    """The parts of Markdown that give structure: headings, lists, quotes, fenced code, pipe tables and paragraphs. Raw HTML is text."""
    from html import escape

    out: list[str] = []
    lines = text.replace("\r\n", "\n").split("\n")
    i = 0
    para: list[str] = []

    def flush() -> None:
        if para:
            out.append("<p>" + "\n".join(para) + "</p>")
            para.clear()

    def inline(s: str) -> str:
        s = escape(s, quote=False)
        s = re.sub(r"!\[([^\]]*)\]\([^)]*\)", r"\1", s)
        s = re.sub(r"\[([^\]]+)\]\([^)]*\)", r"\1", s)
        return re.sub(r"(\*\*|__|\*|_|`)(?=\S)(.+?)(?<=\S)\1", r"\2", s)

    while i < len(lines):
        line = lines[i]
        fence = re.match(r"\s*(```|~~~)", line)
        head = re.match(r"(#{1,6})\s+(.*?)\s*#*\s*$", line)
        item = re.match(r"\s*(?:[-*+]|\d+[.)])\s+(.*)", line)
        if fence:
            flush()
            body = []
            i += 1
            while i < len(lines) and not lines[i].strip().startswith(fence[1]):
                body.append(lines[i])
                i += 1
            out.append("<pre>" + escape("\n".join(body), quote=False) + "</pre>")
        elif head:
            flush()
            out.append(f"<h{len(head[1])}>{inline(head[2])}</h{len(head[1])}>")
        elif "|" in line and i + 1 < len(lines) and re.fullmatch(r"\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*", lines[i + 1]):
            flush()
            rows = [line]
            i += 2
            while i < len(lines) and "|" in lines[i] and lines[i].strip():
                rows.append(lines[i])
                i += 1
            cells = [[inline(c.strip()) for c in re.split(r"(?<!\\)\|", r.strip().strip("|"))] for r in rows]
            out.append("<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in cells) + "</table>")
            continue
        elif para and re.fullmatch(r"\s*(=+|-+)\s*", line):
            level = 1 if "=" in line else 2
            name = " ".join(para)
            para.clear()
            out.append(f"<h{level}>{name}</h{level}>")
        elif item:
            flush()
            out.append(f"<li>{inline(item[1])}</li>")
        elif line.lstrip().startswith(">"):
            flush()
            out.append(f"<blockquote>{inline(line.lstrip()[1:].strip())}</blockquote>")
        elif not line.strip():
            flush()
        else:
            para.append(inline(line))
        i += 1
    flush()
    return "\n".join(out)


# Text formats


def delimited_blocks(text: str, tab: bool) -> list[Block]:
    """One block a row, its filled cells with their column letters."""
    out = []
    for n, row in enumerate(csv.reader(io.StringIO(text, newline=""), delimiter="\t" if tab else ",", strict=False), 1):
        cells = [(spreadsheet_column(i), v.strip()) for i, v in enumerate(row, 1) if v.strip()]
        if cells:
            ends = [f"{c}{n}" for c in dict.fromkeys((cells[0][0], cells[-1][0]))]
            out.append(Block("\t".join(f"{c}: {v}" for c, v in cells), kind="sheet", sheet="TSV" if tab else "CSV", cell_range=":".join(ends)))
    return out


def _relaxed_json(text: str):
    """JSON with comments and trailing commas, numbers as they are written."""

    def strip(m: re.Match) -> str:
        return m[0] if m[0][0] == '"' else " "

    try:
        return json.loads(text, parse_float=_Raw, parse_int=_Raw, parse_constant=_reject)
    except ValueError:
        plain = re.sub(r'"(?:\\.|[^"\\])*"|//[^\n]*|/\*.*?\*/', strip, text, flags=re.S)
        plain = re.sub(r'("(?:\\.|[^"\\])*")|,(?=\s*[\]}])', lambda m: m[1] or "", plain)
        return json.loads(plain, parse_float=_Raw, parse_int=_Raw, parse_constant=_reject)


class _Raw(str):
    """A number as it is written."""


def _reject(name: str):
    raise ValueError(name)


def flatten_json(value, path: str = "$", depth: int = 0) -> Iterator[str]:
    """``path: value`` of every leaf; empty objects and arrays are leaves."""
    if depth > 128:
        raise ValueError("too deep")
    if isinstance(value, dict) and value:
        for k, v in value.items():
            yield from flatten_json(v, f"{path}.{k}" if re.fullmatch(r"[^\W\d]\w*", k) else f"{path}[{json.dumps(k, ensure_ascii=False)}]", depth + 1)
    elif isinstance(value, list) and value:
        for i, v in enumerate(value):
            yield from flatten_json(v, f"{path}[{i}]", depth + 1)
    else:
        yield f"{path}: {value if isinstance(value, str) else json.dumps(value)}"


def json_blocks(text: str) -> list[Block]:
    try:
        lines = list(flatten_json(_relaxed_json(text)))
    except (ValueError, RecursionError) as e:
        raise ExtractionError("malformed_document", "JSON document is malformed") from e
    return [Block("\n".join(lines), kind="structure", path="$")]


def json_line_blocks(text: str) -> list[Block]:
    out = []
    for n, line in enumerate(text.splitlines(), 1):
        if line.strip():
            try:
                shown = "\n".join(flatten_json(_relaxed_json(line)))
            except (ValueError, RecursionError):
                shown = line
            out.append(Block(shown, kind="structure", path=f"line[{n}]"))
    return out


def _xml(data: bytes | str) -> ET.Element:
    raw = data if isinstance(data, str) else decode(data)
    if re.search(r"<!DOCTYPE[^>]*\[|<!ENTITY", raw):
        raise ExtractionError("malformed_document", "entities are not read")
    try:
        return ET.fromstring(re.sub(r"^\s*<\?xml[^>]*\?>", "", raw))
    except ET.ParseError as e:
        raise ExtractionError("malformed_document", "XML document is malformed") from e


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def xml_blocks(data: bytes) -> list[Block]:
    """One block for each element with attributes or text of its own, at its path of names."""
    out = []

    def walk(e: ET.Element, path: str) -> None:
        path = f"{path}/{_local(e.tag)}"
        own = ((e.text or "") + "".join(c.tail or "" for c in e)).strip()
        parts = [f"@{_local(k)}: {v}" for k, v in e.attrib.items()] + [own]
        shown = "\n".join(p for p in parts if p.strip())
        if shown:
            out.append(Block(shown, kind="structure", path=path))
        for c in e:
            if isinstance(c.tag, str):
                walk(c, path)

    walk(_xml(data), "")
    return out


_RTF = re.compile(r"\\([a-zA-Z]{1,32})(-?\d{1,10})? ?|\\'([0-9a-fA-F]{2})|\\([^a-zA-Z])|([{}])|[\r\n]+|(.)", re.S)
#: Destinations of rich text that hold no text, and what some control words stand for (fixed values).
_RTF_SKIPPED = {"fonttbl", "colortbl", "stylesheet", "info", "pict", "header", "footer", "headerl", "headerr", "footerl", "footerr", "generator", "object", "themedata", "datastore", "listtable", "listoverridetable", "rsidtbl", "xmlnstbl", "latentstyles"}
_RTF_SIGNS = {"par": "\n", "sect": "\n\n", "page": "\n\n", "line": "\n", "tab": "\t", "cell": "\t", "row": "\n", "emdash": "—", "endash": "–", "emspace": " ", "enspace": " ", "bullet": "•", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”"}


def rtf_text(text: str) -> str:
    """The text of a rich text file."""
    out: list[str] = []
    stack: list[tuple[bool, int]] = []
    skip, width, left, first = False, 1, 0, False
    for m in _RTF.finditer(text):
        word, number, code, sign, brace, char = m.groups()
        starting, first = first, False
        if brace == "{":
            stack.append((skip, width))
            first, left = True, 0
        elif brace == "}":
            skip, width = stack.pop() if stack else (False, 1)
            left = 0
        elif sign is not None:
            if sign == "*" and starting:
                skip = True
            elif not skip and sign in "{}\\~-_":
                out.append({"~": " ", "-": "­", "_": "‑"}.get(sign, sign))
        elif word:
            if starting and word in _RTF_SKIPPED:
                skip = True
            elif word == "uc":
                width = int(number or 1)
            elif word == "u" and number is not None:
                if not skip:
                    out.append(chr(int(number) % 65536))
                left = width
            elif word == "bin":
                left = 0
            elif word in _RTF_SIGNS and not skip:
                out.append(_RTF_SIGNS[word])
        elif code:
            if left:
                left -= 1
            elif not skip:
                out.append(bytes([int(code, 16)]).decode("cp1252", "replace"))
        elif char:
            if left:
                left -= 1
            elif not skip:
                out.append(char)
    return "".join(out).encode("utf-16", "surrogatepass").decode("utf-16", "replace")


# Office files


class _Package:
    """A zip of parts, with relations between them."""

    def __init__(self, data: bytes):
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data))
        except zipfile.BadZipFile as e:
            raise ExtractionError("malformed_document", "not a package") from e
        self.names = {i.filename for i in self.zip.infolist()}

    def read(self, name: str) -> bytes:
        info = self.zip.getinfo(name)
        if info.flag_bits & 1:
            raise ExtractionError("encrypted_document", "the package is encrypted")
        if info.file_size > MAX_ONE:
            raise ExtractionError("attachment_size_limit", f"{name} exceeds {MAX_ONE} bytes")
        return self.zip.read(name)

    def xml(self, name: str) -> ET.Element | None:
        return _xml(self.read(name)) if name in self.names else None

    def relations(self, part: str) -> list[tuple[str, str, str]]:
        """(id, type's last word, part) of what a part refers to inside the package."""
        folder, base = posixpath.split(part)
        root = self.xml(posixpath.join(folder, "_rels", base + ".rels"))
        out = []
        for r in root if root is not None else ():
            if r.get("TargetMode") != "External":
                to = r.get("Target", "")
                out.append((r.get("Id", ""), r.get("Type", "").rsplit("/", 1)[-1], to.lstrip("/") if to.startswith("/") else posixpath.normpath(posixpath.join(folder, to))))
        return out

    def title(self) -> str | None:
        core = self.xml("docProps/core.xml")
        found = next((e.text for e in core.iter() if _local(e.tag) == "title" and e.text), None) if core is not None else None
        return for_display(found)[:500] or None

    def embedded(self, part: str) -> Iterator[tuple[str, bytes]]:
        """(name, bytes) of the files embedded in a part or the parts it refers to."""
        todo, seen = [part], {part}
        while todo:
            for _, kind, to in self.relations(todo.pop(0)):
                if to in seen or to not in self.names:
                    continue
                seen.add(to)
                if kind in ("package", "oleObject", "image") or "/embeddings/" in to or "/media/" in to:
                    yield posixpath.basename(to), self.read(to)
                elif to.endswith(".xml"):
                    todo.append(to)


def _text(e: ET.Element | None) -> str:
    """The runs of text under an element, joined by blanks."""
    return " ".join(t.text for t in e.iter() if _local(t.tag) == "t" and t.text and t.text.strip()) if e is not None else ""


def _value(e: ET.Element | None, *path: str) -> str | None:
    """The val attribute at a path of local names."""
    for name in path:
        e = next((c for c in e if _local(c.tag) == name), None) if e is not None else None
    return None if e is None else next((v for k, v in e.attrib.items() if _local(k) == "val"), None)


def word_node(data: bytes, node: Node) -> Iterator[tuple[str, bytes]]:
    p = _Package(data)
    main = next((to for _, kind, to in p.relations("") if kind == "officeDocument"), "word/document.xml") if "_rels/.rels" in p.names else "word/document.xml"
    root = p.xml(main)
    body = next((e for e in root if _local(e.tag) == "body"), None) if root is not None else None
    if body is None:
        raise ExtractionError("malformed_document", "no document body")
    relations = p.relations(main)
    part = lambda kind: [to for _, k, to in relations if k == kind and to in p.names]
    styles = {}
    for s in part("styles"):
        for e in p.xml(s):  # type: ignore[union-attr]
            if _local(e.tag) == "style":
                ident = next((v for k, v in e.attrib.items() if _local(k) == "styleId"), None)
                styles.setdefault(ident, e)

    def level(par: ET.Element) -> int:
        own = _value(par, "pPr", "outlineLvl")
        if own is not None:
            return int(own) + 1 if own.isdigit() and int(own) <= 8 else 0
        ident, seen = _value(par, "pPr", "pStyle"), set()
        while ident and ident not in seen and len(seen) < 32:
            seen.add(ident)
            style = styles.get(ident)
            outline = _value(style, "pPr", "outlineLvl")
            if outline is not None:
                return int(outline) + 1 if outline.isdigit() and int(outline) <= 8 else 0
            m = re.fullmatch(r"heading([1-9])", (_value(style, "name") or ident).replace(" ", ""), re.I)
            if m:
                return int(m[1])
            ident = _value(style, "basedOn")
        return 0

    heads, paragraphs, tables = Headings(), 0, 0

    def walk(e: ET.Element) -> None:
        nonlocal paragraphs, tables
        for c in e:
            tag = _local(c.tag)
            if tag == "p":
                paragraphs += 1
                text = _text(c)
                if text.strip():
                    n = level(c)
                    if n:
                        heads.start(n, text)
                    node.blocks.append(Block(text, kind="structure", path=f"document/paragraph[{paragraphs}]", **heads.fields))
            elif tag == "tbl":
                tables += 1
                rows = ["\t".join(_text(x) for x in r if _local(x.tag) == "tc") for r in c if _local(r.tag) == "tr"]
                text = "\n".join(r for r in rows if r.strip())
                spans = any(_local(x.tag) in ("vMerge", "hMerge") or _local(x.tag) == "gridSpan" and next(iter(x.attrib.values()), "1") != "1" for x in c.iter())
                if text.strip():
                    node.blocks.append(Block(text, kind="structure", path=f"document/table[{tables}]", warning=SPANS if spans else None, **heads.fields))
            elif tag == "sdt":
                for inner in c:
                    if _local(inner.tag) == "sdtContent":
                        walk(inner)

    walk(body)
    for kind in ("header", "footer"):
        for n, to in enumerate(part(kind), 1):
            _add(node, _text(p.xml(to)), f"{kind}[{n}]", True)
    for kind in ("footnotes", "endnotes", "comments"):
        for to in part(kind):
            _add(node, _text(p.xml(to)), kind)
    alts = [" ".join(v for v in (e.get("title"), e.get("descr")) if v and v.strip()) for e in body.iter() if _local(e.tag) == "docPr"]
    for n, alt in enumerate((a for a in alts if a), 1):
        node.blocks.append(Block(alt, kind="structure", path=f"document/alt-text[{n}]"))
    node.title = p.title()
    yield from p.embedded(main)


def _add(node: Node, text: str, path: str, boilerplate: bool = False) -> None:
    if text.strip():
        node.blocks.append(Block(text, kind="structure", path=path, key=path, boilerplate=boilerplate))


def excel_format(code_id: int, custom: dict[int, str]) -> tuple[bool, bool, bool]:
    """(date, time, elapsed) of a number format."""
    if 14 <= code_id <= 17:
        return True, False, False
    if 18 <= code_id <= 21 or code_id in (45, 47):
        return False, True, False
    if code_id == 22:
        return True, True, False
    if code_id == 46:
        return False, True, True
    code = custom.get(code_id)
    if not code or ";" in code or re.search(r"\[[<>=]", code):
        return False, False, False
    elapsed = bool(re.search(r"\[[hms]+\]", code, re.I))
    plain = re.sub(r'"[^"]*"?|[\\_*].|\[[^\]]*\]', "", code).lower()
    time = elapsed or "h" in plain or "s" in plain or "am/pm" in plain or "a/p" in plain
    rest = plain.replace("am/pm", "").replace("a/p", "")
    return "y" in rest or "d" in rest or "mmm" in rest or "m" in rest and not time, time, elapsed


def excel_date(raw: str, kind: tuple[bool, bool, bool], since_1904: bool = False) -> str:
    """A number shown as the date or time its format means, with the number. The calendar that begins in 1900 has a 29 February of that year."""
    date, time, elapsed = kind
    try:
        serial = float(raw)
    except ValueError:
        return raw
    if not (date or time) or not 0 <= serial < 2_958_466 or date and not since_1904 and serial < 1:
        return raw
    clock = (datetime(1, 1, 1) + timedelta(days=serial % 1)).strftime("%H:%M:%S")
    if elapsed:
        seconds = round(serial * 86400)
        shown = f"{seconds // 3600}:{seconds // 60 % 60:02}:{seconds % 60:02}"
    elif date and not since_1904 and int(serial) == 60:
        shown = "1900-02-29 (Excel 1900 leap-day)" + (f"T{clock}" if time else "")
    elif date:
        day = (datetime(1904, 1, 1) if since_1904 else datetime(1899, 12, 31)) + timedelta(days=serial - (not since_1904 and serial >= 60))
        shown = day.strftime("%Y-%m-%dT%H:%M:%S" if time else "%Y-%m-%d")
    else:
        shown = clock
    return f"{shown} (Excel serial: {raw})"


def spreadsheet_node(data: bytes, node: Node) -> Iterator[tuple[str, bytes]]:
    p = _Package(data)
    main = "xl/workbook.xml"
    book = p.xml(main)
    if book is None:
        raise ExtractionError("malformed_document", "no workbook")
    relations = {i: (k, to) for i, k, to in p.relations(main)}
    one = lambda kind: next((p.xml(to) for k, to in relations.values() if k == kind and to in p.names), None)
    shared_root = one("sharedStrings")
    shared = [_text(s) for s in shared_root] if shared_root is not None else []
    styles = one("styles")
    custom: dict[int, str] = {}
    formats: list[int] = []
    if styles is not None:
        for e in styles.iter():
            if _local(e.tag) == "numFmt" and e.get("numFmtId"):
                custom.setdefault(int(e.get("numFmtId", "0")), e.get("formatCode", ""))
        xfs = next((e for e in styles if _local(e.tag) == "cellXfs"), None)
        formats = [int(x.get("numFmtId", "0")) for x in xfs] if xfs is not None else []
    since = any(_local(e.tag) == "workbookPr" and e.get("date1904") in ("1", "true") for e in book.iter())
    sheets = [e for e in book.iter() if _local(e.tag) == "sheet"]
    for n, s in enumerate(sheets, 1):
        ident = next((v for k, v in s.attrib.items() if _local(k) == "id"), None)
        to = relations.get(ident, ("", ""))[1]
        if to not in p.names:
            continue
        name = s.get("name") or f"Sheet{n}"
        for _, row in ET.iterparse(io.BytesIO(p.read(to))):
            if _local(row.tag) != "row":
                continue
            values, refs = [], []
            for c in row:
                if _local(c.tag) != "c":
                    continue
                ref = c.get("r", "")
                refs.append(ref)
                v = next((x.text or "" for x in c if _local(x.tag) == "v"), None)
                f = next((x.text or "" for x in c if _local(x.tag) == "f"), None)
                kind = c.get("t")
                if kind == "inlineStr":
                    text = _text(c)
                elif f is not None and not (v or "").strip():
                    text = f"{f} (formula; no cached value)"
                elif kind == "s" and (v or "").isdigit() and int(v or 0) < len(shared):
                    text = shared[int(v or 0)]
                else:
                    text = v or ""
                    style = int(c.get("s", "0"))
                    if v is not None and kind in (None, "n") and style < len(formats):
                        text = excel_date(text, excel_format(formats[style], custom), since)
                if text.strip():
                    values.append(f"{ref}: {text}")
            if values:
                node.blocks.append(Block("\t".join(values), kind="sheet", sheet=name, cell_range=":".join(dict.fromkeys((refs[0], refs[-1])))))
            row.clear()
        for _, kind, part in p.relations(to):
            if part not in p.names:
                continue
            if kind == "comments":
                for c in p.xml(part).iter():  # type: ignore[union-attr]
                    if _local(c.tag) == "comment" and _text(c).strip():
                        node.blocks.append(Block(_text(c), kind="sheet", sheet=name, cell_range=c.get("ref"), path="comment"))
            elif kind == "drawing":
                text = _text(p.xml(part))
                if text.strip():
                    node.blocks.append(Block(text, kind="sheet", sheet=name, path="drawing-text"))
    node.title = p.title()
    yield from p.embedded(main)


def presentation_node(data: bytes, node: Node) -> Iterator[tuple[str, bytes]]:
    p = _Package(data)
    main = "ppt/presentation.xml"
    root = p.xml(main)
    if root is None:
        raise ExtractionError("malformed_document", "no presentation")
    relations = {i: to for i, _, to in p.relations(main)}
    order = [relations.get(next((v for k, v in e.attrib.items() if k.endswith("}id")), "")) for e in root.iter() if _local(e.tag) == "sldId"]
    for n, part in enumerate((o for o in order if o in p.names), 1):
        slide = p.xml(part)
        title, texts, tables = None, [], []
        for shape in slide.iter():  # type: ignore[union-attr]
            tag = _local(shape.tag)
            if tag == "sp":
                text = "\n".join(t for t in (_text(par) for par in shape.iter() if _local(par.tag) == "p") if t.strip())
                kind = next((e.get("type") for e in shape.iter() if _local(e.tag) == "ph"), None)
                if text and kind in ("title", "ctrTitle") and title is None:
                    title = text
                elif text:
                    texts.append(text)
            elif tag == "tbl":
                tables.append("\n".join("\t".join(_text(c) for c in r if _local(c.tag) == "tc") for r in shape if _local(r.tag) == "tr"))
        place = {"kind": "slide", "slide": n, "heading": title, "heading_path": (title,) if title else (), "key": f"slide:{n}"}
        if title or texts:
            node.blocks.append(Block("\n".join(x for x in (title, *texts) if x), path="slide", **place))
        for k, t in enumerate((t for t in tables if t.strip()), 1):
            node.blocks.append(Block(t, path=f"slide/table[{k}]", **place))
        for k, alt in enumerate((a for a in (" ".join(v for v in (e.get("title"), e.get("descr")) if v and v.strip()) for e in slide.iter() if _local(e.tag) == "cNvPr") if a), 1):  # type: ignore[union-attr]
            node.blocks.append(Block(alt, path=f"slide/alt-text[{k}]", **place))
        for _, kind, to in p.relations(part):
            if kind in ("notesSlide", "comments") and to in p.names:
                text = _text(p.xml(to)) if kind == "notesSlide" else " ".join(e.text for e in p.xml(to).iter() if _local(e.tag) in ("text", "t") and e.text)  # type: ignore[union-attr]
                if text.strip():
                    node.blocks.append(Block(text, path="notes" if kind == "notesSlide" else "comments", **place))
    node.title = p.title()
    yield from p.embedded(main)


def _odf_text(e: ET.Element) -> str:
    out = [e.text or ""]
    for c in e:
        tag = _local(c.tag)
        if tag == "s":
            out.append(" " * int(next((v for k, v in c.attrib.items() if _local(k) == "c"), "1")))
        elif tag == "tab":
            out.append("\t")
        elif tag == "line-break":
            out.append("\n")
        elif tag not in ("note", "annotation"):
            out.append(_odf_text(c))
        out.append(c.tail or "")
    return "".join(out)


def _attr(e: ET.Element, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if _local(k) == name), None)


def open_document_node(data: bytes, node: Node, kind: str) -> Iterator[tuple[str, bytes]]:
    p = _Package(data)
    root = p.xml("content.xml")
    if root is None:
        raise ExtractionError("malformed_document", "no content")
    body = next((e for e in root.iter() if _local(e.tag) in ("text", "spreadsheet", "presentation") and e.tag.startswith("{urn:oasis:names:tc:opendocument:xmlns:office")), root)
    heads, counts = Headings(), {"paragraph": 0, "table": 0}

    def rows_of(table: ET.Element) -> Iterator[tuple[int, list[tuple[int, str]]]]:
        """(row number, (column, text) of filled cells); repeated rows and cells count, empty ones are not made."""
        n = 0
        for r in table.iter():
            if _local(r.tag) != "table-row":
                continue
            again = int(_attr(r, "number-rows-repeated") or 1)
            cells, col = [], 0
            for c in r:
                if _local(c.tag) not in ("table-cell", "covered-table-cell"):
                    continue
                times = int(_attr(c, "number-columns-repeated") or 1)
                text = "\n".join(_odf_text(x) for x in c if _local(x.tag) in ("p", "h")).strip() or (_attr(c, "value") or "")
                if text:
                    cells += [(col + k + 1, text) for k in range(min(times, 1024))]
                col += times
            for k in range(min(again, 1024) if cells else 0):
                yield n + k + 1, cells
            n += again

    if kind == "ods":
        for t in (e for e in body if _local(e.tag) == "table"):
            for n, cells in rows_of(t):
                ends = dict.fromkeys((f"{spreadsheet_column(cells[0][0])}{n}", f"{spreadsheet_column(cells[-1][0])}{n}"))
                node.blocks.append(Block("\t".join(f"{spreadsheet_column(c)}{n}: {v}" for c, v in cells), kind="sheet", sheet=_attr(t, "name"), cell_range=":".join(ends)))
    elif kind == "odp":
        for n, page in enumerate((e for e in body.iter() if _local(e.tag) == "page"), 1):
            notes = next((e for e in page if _local(e.tag) == "notes"), None)
            held = set(notes.iter()) if notes is not None else set()
            text = "\n".join(t for t in (_odf_text(e).strip() for e in page.iter() if _local(e.tag) in ("p", "h") and e not in held) if t)
            if text:
                node.blocks.append(Block(text, kind="slide", slide=n, path="slide", heading=_attr(page, "name"), key=f"slide:{n}"))
            said = "\n".join(t for t in (_odf_text(e).strip() for e in held if _local(e.tag) in ("p", "h")) if t)
            if said:
                node.blocks.append(Block(said, kind="slide", slide=n, path="notes", key=f"slide:{n}"))
    else:

        def walk(e: ET.Element) -> None:
            for c in e:
                tag = _local(c.tag)
                if tag in ("h", "p"):
                    counts["paragraph"] += 1
                    text = _odf_text(c).strip()
                    if text:
                        if tag == "h":
                            heads.start(int(_attr(c, "outline-level") or 1), text)
                        node.blocks.append(Block(text, kind="structure", path=f"document/paragraph[{counts['paragraph']}]", **heads.fields))
                elif tag == "table":
                    counts["table"] += 1
                    width = 0
                    grid = [dict(cells) for _, cells in rows_of(c)]
                    width = max((max(g) for g in grid), default=0)
                    text = "\n".join("\t".join(g.get(k, "") for k in range(1, width + 1)) for g in grid)
                    if text.strip():
                        node.blocks.append(Block(text, kind="structure", path=f"document/table[{counts['table']}]", **heads.fields))
                elif tag not in ("tracked-changes", "forms", "sequence-decls"):
                    walk(c)

        walk(body)
    meta = p.xml("meta.xml")
    node.title = next((for_display(e.text)[:500] for e in meta.iter() if _local(e.tag) == "title" and e.text), None) if meta is not None else None
    for name in sorted(p.names):
        if name.startswith(("Pictures/", "Object")) and "." in posixpath.basename(name) and not name.endswith(".xml"):
            yield posixpath.basename(name), p.read(name)


def epub_node(data: bytes, node: Node) -> Iterator[tuple[str, bytes]]:
    p = _Package(data)
    container = p.xml("META-INF/container.xml")
    opf = next((e.get("full-path") for e in container.iter() if _local(e.tag) == "rootfile"), None) if container is not None else None
    root = p.xml(opf or "")
    if root is None:
        raise ExtractionError("malformed_document", "no package document")
    folder = posixpath.dirname(opf or "")
    items = {e.get("id"): posixpath.normpath(posixpath.join(folder, e.get("href", ""))) for e in root.iter() if _local(e.tag) == "item"}
    for n, ref in enumerate((e.get("idref") for e in root.iter() if _local(e.tag) == "itemref"), 1):
        part = items.get(ref)
        if part in p.names:
            blocks, _ = html_blocks(decode(p.read(part)), prefix=f"spine[{n}]/")
            node.blocks += [replace(b, key=f"spine[{n}]:{b.key}") for b in blocks]
    node.title = next((for_display(e.text)[:500] for e in root.iter() if _local(e.tag) == "title" and e.text), None)
    yield from ()


# Mail and archives


def mail_node(data: bytes, node: Node, archive: bool = False) -> Iterator[tuple[str, bytes, str, str]]:
    m = email.message_from_bytes(data, policy=email.policy.default)
    head = lambda k: str(m.get(k, "") or "")
    if not archive:
        date = m.get("Date")
        moment = getattr(date, "datetime", None)
        when = moment.strftime("%Y-%m-%dT%H:%M:%S.%f") + "0" + (moment.strftime("%z")[:3] + ":" + moment.strftime("%z")[3:] if moment.tzinfo else "+00:00") if moment else ""
        bcc = f"\nBcc: {head('Bcc')}" if head("Bcc").strip() else ""
        node.blocks.append(Block(f"From: {head('From')}\nTo: {head('To')}\nCc: {head('Cc')}{bcc}\nDate: {when}\nSubject: {head('Subject')}", kind="email_part", email_part="headers", method="Email", key="email:headers"))

    def text_of(kind: str) -> str:
        part = m.get_body(preferencelist=(kind,))
        if part is None:
            return ""
        try:
            return part.get_content()
        except (LookupError, UnicodeError, KeyError):
            return decode(part.get_payload(decode=True) or b"")

    plain, html = text_of("plain"), text_of("html")
    base = Block("", kind="document", method="Html") if archive else Block("", kind="email_part", email_part="body", method="Html")
    if archive and html.strip() or not plain.strip() and html.strip():
        node.blocks += html_blocks(html, base)[0]
    elif plain.strip():
        node.blocks.append(replace(base, text=plain, method="NativeText" if archive else "Email", key="document" if archive else "email:body"))
    for n, part in enumerate(m.iter_attachments() if m.is_multipart() else (), 1):
        inline = part.get_content_disposition() != "attachment"
        if part.get_content_type() == "message/rfc822":
            inner = part.get_payload()
            yield part.get_filename() or f"message-{n}.eml", (inner[0] if isinstance(inner, list) else inner).as_bytes(), "message/rfc822", "email-attachment"
        else:
            yield part.get_filename() or f"attachment-{n}", part.get_payload(decode=True) or b"", part.get_content_type(), "email-inline" if inline else "email-attachment"


def archive_members(data: bytes, name: str, extension: str) -> Iterator[tuple[str, bytes | None, str | None]]:
    """(name, bytes, error) of an archive's files; encrypted and oversized ones come with an error."""
    if extension == ".zip":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for i in z.infolist():
                if i.is_dir():
                    continue
                if i.flag_bits & 1:
                    yield i.filename, None, "encrypted_archive_entry"
                elif i.file_size > MAX_ONE:
                    yield i.filename, None, "attachment_size_limit"
                else:
                    try:
                        yield i.filename, z.read(i), None
                    except (zipfile.BadZipFile, OSError, EOFError, NotImplementedError):
                        yield i.filename, None, "malformed_archive_entry"
    elif extension in (".tar", ".tgz", ".tar.gz"):
        with tarfile.open(fileobj=io.BytesIO(data)) as t:
            for member in t:
                if member.isfile():
                    f = t.extractfile(member)
                    yield (member.name, None, "attachment_size_limit") if member.size > MAX_ONE or f is None else (member.name, f.read(), None)
    elif extension == ".gz":
        with gzip.open(io.BytesIO(data)) as g:
            body = g.read(MAX_ONE + 1)
        inner = re.sub(r"\.gz$", "", posixpath.basename(name), flags=re.I) or "content"
        yield (inner, None, "attachment_size_limit") if len(body) > MAX_ONE else (inner, body, None)
    else:
        raise ExtractionError("unsupported_format", f"{extension} archives cannot be opened here")


def pdf_blocks(data: bytes) -> list[Block]:
    """The paragraphs of a PDF file's pages. A page without text, as scanned ones are, is a block without any, with a warning."""
    out = []
    try:
        for number, boxes in pdf_pages(data):
            out += [Block(b.text, kind="page", page=number, region=(b.x, b.y, b.w, b.h), key=f"page:{number}") for b in boxes] or [Block("", kind="page", page=number, warning="no_text", key=f"page:{number}")]
    except PermissionError as e:
        raise ExtractionError("encrypted_document", str(e)) from e
    return out


class Extractor:
    """Opens one file and all it holds. ``recognise`` reads images where a recogniser is at hand: bytes → blocks."""

    def __init__(self, recognise: Callable[[bytes], list[Block]] | None = None):
        self.recognise = recognise
        self.problems: list[Problem] = []
        self.count, self.bytes = 0, 0

    def file(self, data: bytes, name: str) -> Node:
        self.problems, self.count, self.bytes = [], 0, 0
        return self._open(data, name, None, "root", 0, (), name)

    def _fail(self, code: str, message: str, component: str, node: Node) -> Node:
        self.problems.append(Problem(code, message, component, code == "io_error"))
        node.status = "error"
        return node

    def _open(self, data: bytes, name: str, media: str | None, relationship: str, depth: int, above: tuple[bytes, ...], component: str) -> Node:
        node = Node(name, media, relationship)
        if len(data) > MAX_ONE:
            return self._fail("attachment_size_limit", f"{len(data)} bytes", component, node)
        mark = hashlib.sha256(data).digest()
        if mark in above:
            return self._fail("attachment_cycle", "a file that holds itself", component, node)
        found = resolve(data, name, media)
        if found is None:
            return self._fail("unsupported_format", "unknown format", component, node)
        extension, kind = found
        children: Iterator = iter(())
        try:
            if kind in ("text", "rtf"):
                text = decode(data) if kind == "text" else rtf_text(decode(data))
                node.blocks = [Block(text, kind="document")] if text.strip() else []
            elif kind == "markdown":
                node.blocks = html_blocks(markdown_to_html(decode(data)))[0]
            elif kind == "html":
                node.blocks, node.title = html_blocks(decode(data))
            elif kind == "delimited":
                node.blocks = delimited_blocks(decode(data), extension == ".tsv")
            elif kind == "json":
                node.blocks = json_blocks(decode(data))
            elif kind == "jsonl":
                node.blocks = json_line_blocks(decode(data))
            elif kind == "xml":
                node.blocks = xml_blocks(data)
            elif kind in ("word", "spreadsheet", "presentation"):
                children = ((n, d, None, "embedded") for n, d in {"word": word_node, "spreadsheet": spreadsheet_node, "presentation": presentation_node}[kind](data, node))
            elif kind in ("odt", "ods", "odp"):
                children = ((n, d, None, "embedded") for n, d in open_document_node(data, node, kind))
            elif kind == "epub":
                children = iter([(n, d, None, "embedded") for n, d in epub_node(data, node)])
            elif kind in ("eml", "mhtml"):
                children = mail_node(data, node, kind == "mhtml")
            elif kind == "msg":
                children = mail_node(outlook_mail(data), node)
            elif kind == "archive":
                children = self._members(data, name, extension, node, component)
            elif kind == "pdf":
                node.blocks = pdf_blocks(data)
            elif kind == "image" and self.recognise:
                node.blocks = self.recognise(data)
            else:
                return self._fail("unsupported_format", f"{kind} cannot be read here", component, node)
            for child in children:
                n, body, media_type, relation = child
                if depth + 1 > MAX_DEPTH:
                    self._fail("nesting_limit", f"deeper than {MAX_DEPTH}", component, node)
                    break
                self.count += 1
                self.bytes += len(body)
                if self.count > MAX_ATTACHMENTS or self.bytes > MAX_TOTAL:
                    self._fail("attachment_limit", "too many or too large attachments", component, node)
                    break
                node.children.append(self._open(body, n, media_type, relation, depth + 1, (*above, mark), f"{component}/{n}"))
        except ExtractionError as e:
            return self._fail(e.code, str(e), component, node)
        except (zipfile.BadZipFile, tarfile.TarError, OSError, EOFError, ValueError, KeyError, IndexError, TypeError, struct.error, ET.ParseError, RecursionError) as e:
            return self._fail("malformed_document", f"{type(e).__name__}: {e}"[:300], component, node)
        return node

    def _members(self, data: bytes, name: str, extension: str, node: Node, component: str) -> Iterator[tuple]:
        for n, body, error in archive_members(data, name, extension):
            if error:
                child = Node(n, None, "archive-entry")
                node.children.append(self._fail(error, n, f"{component}/{n}", child))
            else:
                yield n, body, None, "archive-entry"


def materialise(data: bytes, name: str, ordinals: list[int]) -> bytes | None:
    """The bytes of a content, by its ordinals from the root: what opening an attachment again gives. Null where there is none."""
    for k in ordinals:
        found = resolve(data, name)
        if found is None:
            return None
        extension, kind = found
        node = Node(name)
        if kind in ("eml", "mhtml"):
            inside = [(n, d) for n, d, _, _ in mail_node(data, node, kind == "mhtml")]
        elif kind == "msg":
            inside = [(n, d) for n, d, _, _ in mail_node(outlook_mail(data), node)]
        elif kind == "archive":
            inside = [(n, d) for n, d, e in archive_members(data, name, extension) if not e]
        elif kind in ("word", "spreadsheet", "presentation"):
            inside = list({"word": word_node, "spreadsheet": spreadsheet_node, "presentation": presentation_node}[kind](data, node))
        elif kind in ("odt", "ods", "odp"):
            inside = list(open_document_node(data, node, kind))
        else:
            return None
        if k >= len(inside):
            return None
        name, data = inside[k]
    return data


# Spark

BLOCK_TYPE = T.StructType([T.StructField("text", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("page", T.IntegerType()), T.StructField("sheet", T.StringType()), T.StructField("cell_range", T.StringType()), T.StructField("slide", T.IntegerType()), T.StructField("path", T.StringType()),
                           T.StructField("email_part", T.StringType()), T.StructField("frame", T.IntegerType()), T.StructField("warning", T.StringType()), T.StructField("heading", T.StringType()), T.StructField("heading_path", T.ArrayType(T.StringType())), T.StructField("key", T.StringType()),
                           T.StructField("method", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("boilerplate", T.BooleanType())])
NODE_TYPE = T.StructType([T.StructField("node", T.IntegerType()), T.StructField("parent", T.IntegerType()), T.StructField("ordinal", T.IntegerType()), T.StructField("depth", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("media_type", T.StringType()), T.StructField("relationship", T.StringType()),
                          T.StructField("title", T.StringType()), T.StructField("status", T.StringType()), T.StructField("blocks", T.ArrayType(BLOCK_TYPE))])
PROBLEM_TYPE = T.StructType([T.StructField("code", T.StringType()), T.StructField("message", T.StringType()), T.StructField("component", T.StringType()), T.StructField("retryable", T.BooleanType())])
EXTRACTED = T.StructType([T.StructField("path", T.StringType()), T.StructField("sha256", T.StringType()), T.StructField("nodes", T.ArrayType(NODE_TYPE)), T.StructField("errors", T.ArrayType(PROBLEM_TYPE))])


def flatten(root: Node) -> list[dict]:
    """The nodes of a tree in preorder, with their parents' numbers."""
    out: list[dict] = []

    def add(n: Node, parent: int | None, ordinal: int, depth: int) -> None:
        me = len(out)
        keep = [f.name for f in BLOCK_TYPE]
        out.append({"node": me, "parent": parent, "ordinal": ordinal, "depth": depth, "name": n.name, "media_type": n.media_type, "relationship": n.relationship, "title": n.title, "status": n.status,
                    "blocks": [{k: (list(v) if isinstance(v, tuple) else v) for k, v in asdict(b).items() if k in keep} for b in n.blocks]})
        for i, c in enumerate(n.children):
            add(c, me, i, depth + 1)

    add(root, None, 0, 0)
    return out


def read_files(spark: SparkSession, folder: str, extensions: tuple[str, ...] = ()) -> DataFrame:
    """Files of a folder and those below it as (path, modificationTime, length, content); a stream of them with ``spark.readStream``."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if extensions:
        reader = reader.option("pathGlobFilter", "*{" + ",".join(extensions) + "}")
    return reader.load(folder)


def extract_files(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, sha256, nodes, errors) of files. Files over the limit, and null contents, become errors without being opened."""
    big = F.length(content) > MAX_ONE
    rows = files.select(F.col(path).alias("path"), F.when(~big, F.col(content)).alias("content"), F.coalesce(big, F.lit(False)).alias("big"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opener = Extractor()
        for part in parts:
            out = []
            for p, c, b in part.itertuples(index=False):
                name = posixpath.basename((p or "").replace("\\", "/"))
                if c is None:
                    out.append((p, None, [], [asdict(Problem("attachment_size_limit" if b else "io_error", "file not read", name, not b))]))
                    continue
                root = opener.file(bytes(c), name)
                out.append((p, hashlib.sha256(c).hexdigest(), flatten(root), [asdict(x) for x in opener.problems]))
            yield pd.DataFrame(out, columns=["path", "sha256", "nodes", "errors"])

    return rows.mapInPandas(run, EXTRACTED)
