"""Sections, tables and chunks: from extracted blocks in order to the passages that are searched."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import approximate_tokens, canonical, clean_body, compose, ends_sentence, for_display, for_search, name_key, signature_start

#: Sizes of chunks in tokens and characters, and of merged fragments in words (fixed values).
TARGET, MAXIMUM, OVERLAP, MAX_CHARS = 384, 512, 64, 16_000
MERGED_WORDS, FRAGMENT_WORDS = 256, 32
HEADER_CHARS = 500
MINIMUM_OCR = 40

# Relational operators


def assign_keys(blocks: DataFrame, content: str, order: str, boundary: str, explicit: str | None = None, into: str = "section_key") -> DataFrame:
    """Each block with the key of its section: an explicit key, kept until something else begins, or boundary and occurrence where the
    boundary changes. Islands by windows over one content."""
    seq = Window.partitionBy(content).orderBy(order)
    given = F.nullif(F.col(explicit), F.lit("")) if explicit else F.lit(None).cast("string")
    changed = given.isNull() & ~F.col(boundary).eqNullSafe(F.lag(boundary).over(seq)) | given.isNull() & (F.row_number().over(seq) == 1)
    marked = blocks.withColumn("_new", changed.cast("int")).withColumn("_occ", F.sum("_new").over(Window.partitionBy(content, boundary).orderBy(order)) - 1)
    made = F.coalesce(given, F.when(F.col("_new") == 1, F.concat(F.col(boundary), F.lit(":occurrence:"), F.col("_occ").cast("string"))))
    return marked.withColumn("_made", made).withColumn(into, F.last("_made", ignorenulls=True).over(seq)).drop("_new", "_occ", "_made")


def member_offsets(members: DataFrame, section: str, order: Sequence[str], text: str, into: str = "offset") -> DataFrame:
    """Members with their place in the section's text, which joins the non-empty texts by line ends."""
    before = Window.partitionBy(section).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    size = F.length(F.coalesce(F.col(text), F.lit("")))
    full = (size > 0).cast("int")
    chars, count = F.coalesce(F.sum(size).over(before), F.lit(0)), F.coalesce(F.sum(full).over(before), F.lit(0))
    return members.withColumn(into, chars + F.when(size > 0, count).otherwise(F.greatest(F.lit(0), count - 1)))


def build_sections(members: DataFrame, section: str, order: Sequence[str], text: str) -> DataFrame:
    """(section, text, members): the non-empty texts of a section joined by line ends, in order."""
    x = F.array_sort(F.collect_list(F.struct(*order, F.coalesce(F.col(text), F.lit("")).alias("_t"))))
    return members.groupBy(section).agg(x.alias("_x")).select(section, F.array_join(F.filter(F.transform("_x", lambda m: m["_t"]), lambda t: F.length(t) > 0), "\n").alias("text"), F.size("_x").cast("bigint").alias("members"))


def has_substance(body: Column, is_table: Column, method: Column, confidence: Column) -> Column:
    """Whether a cleaned body is worth a vector: two letters at least, tables always, uncertain recognition never."""
    return ~F.coalesce((method == "Ocr") & (confidence < MINIMUM_OCR), F.lit(False)) & (is_table | F.rlike(body, F.lit(r"(?s)\p{L}.*\p{L}")))


# Tables

_CELL = re.compile(r"([A-Z]{1,3})\d*: (.*)", re.S)
_YEAR = re.compile(r"(?:1[89]|2[01])\d\d")


def is_numeric(value: str) -> bool:
    """Digits and no letters, years aside, which name columns."""
    return any(c.isdigit() for c in value) and not any(c.isalpha() for c in value) and not _YEAR.fullmatch(value)


def split_reference(cell: str) -> tuple[str | None, str]:
    """Column letter and value of a cell written with its reference."""
    m = _CELL.fullmatch(cell)
    return (m[1], m[2]) if m else (None, cell)


@dataclass(frozen=True)
class TableHeader:
    cells: tuple[str, ...]
    columns: dict[str, str] = field(default_factory=dict, hash=False)

    @property
    def named(self) -> list[str]:
        return [c for c in self.cells if c]

    @property
    def display(self) -> str:
        return " | ".join(self.named)[:HEADER_CHARS]


def _row_header(row: str, references: bool) -> TableHeader | None:
    pairs = [split_reference(c) if references else (None, c) for c in row.split("\t")]
    cells = [(col, for_search(v)) for col, v in pairs]
    named = [v for _, v in cells if v]
    if not named or 2 * sum(map(is_numeric, named)) >= len(named):
        return None
    return TableHeader(tuple(v for _, v in cells), {col: v for col, v in cells if col and v})


def parse_header(text: str, references: bool = False) -> TableHeader | None:
    """The column names of a table: its first row, unless half of it is numbers; the second where the first is a banner of one cell."""
    rows = [r for r in text.split("\n") if r.strip()]
    if not rows:
        return None
    if not references and len(rows) >= 3 and sum(1 for c in rows[0].split("\t") if c.strip()) == 1:
        second = _row_header(rows[1], False)
        if second and len(second.named) >= 2:
            return second
    return _row_header(rows[0], references)


def linearize(body: str, header: TableHeader, references: bool = False) -> str:
    """Rows as ``Column: value`` pairs; the header's own row only where there is no other."""
    out, own = [], None
    for row in body.split("\n"):
        if not row.strip():
            continue
        cells = row.split("\t")
        aligned = not references and len(cells) == len(header.cells)
        values, only_names = [], True
        for i, cell in enumerate(cells):
            col, value = split_reference(cell) if references else (None, cell)
            value = for_search(value)
            if not value:
                continue
            name = header.columns.get(col) if col else header.cells[i] if aligned else None
            repeats = name is not None and name.casefold() == value.casefold()
            only_names &= repeats
            values.append(value if not name or repeats else f"{name}: {value}")
        if not values:
            continue
        line = "; ".join(values) + "."
        if only_names:
            own = own or line
        else:
            out.append(line)
    return "\n".join(out or ([own] if own else []))


def _row_number(cell_range: str | None) -> int | None:
    m = re.match(r"[A-Za-z]*(\d+)", cell_range or "")
    return int(m[1]) if m else None


def sheet_contexts(rows: Sequence[tuple[str | None, str]]) -> list[tuple[TableHeader | None, str | None]]:
    """Header and caption that hold for each (cell range, text) row of one sheet. A banner row captions the table under it; after a gap a clean
    row of names starts a new table when the next row gives it values or it names other columns."""
    n = len(rows)
    number = [_row_number(r) for r, _ in rows]
    filled = [sum(1 for c in t.split("\t") if c.strip()) for _, t in rows]
    value = lambda t: for_search(t.split(": ", 1)[-1]) or None
    cells = lambda t: {c: for_search(v) for c, v in map(split_reference, t.split("\t")) if c and for_search(v)}

    def clean(text: str) -> TableHeader | None:
        h = parse_header(text, True)
        if h is None or len(h.named) < 2:
            return None
        bad = any(len(c) > 40 or "@" in c or "://" in c or any(x.isdigit() for x in c) and not re.fullmatch(r"(?:19|20)\d\d", c) for c in h.named)
        return None if bad else h

    def starts(h: TableHeader, active: TableHeader | None, below: str) -> bool:
        under = cells(below)
        if any(c in h.columns and any(x.isdigit() for x in v) for c, v in under.items()):
            return True
        return bool(active and active.columns) and any(c not in active.columns for c in h.columns) and all(c in h.columns for c in under)

    if not n:
        return []
    header, caption = parse_header(rows[0][1], True), None
    if n >= 3 and filled[0] == 1 and filled[1] >= 2 and filled[2] >= 2 and (number[0] is None or number[1] is None or number[1] <= number[0] + 2):
        h = parse_header(rows[1][1], True)
        if h and len(h.named) >= 2:
            header, caption = h, value(rows[0][1])
    out = []
    for i in range(n):
        if i >= 2 and number[i] is not None and number[i - 1] is not None and number[i] - number[i - 1] >= 2:
            same = lambda h: header is not None and h.display.casefold() == header.display.casefold()  # noqa: E731, B023
            if filled[i] == 1 and i + 2 < n and number[i + 1] == number[i] + 1 and number[i + 2] == number[i] + 2 and filled[i + 1] >= 2:
                h = clean(rows[i + 1][1])
                if h and (same(h) or starts(h, header, rows[i + 2][1])):
                    header, caption = h, value(rows[i][1])
            elif filled[i] >= 2 and i + 1 < n and number[i + 1] == number[i] + 1:
                h = clean(rows[i][1])
                if h and not same(h) and starts(h, header, rows[i + 1][1]):
                    header = h
        out.append((header, caption))
    return out


# Chunks


def chunk(text: str, table: bool = False, semantic: Callable[[str], str] = lambda t: t, count: Callable[[str], int] = approximate_tokens) -> list[tuple[str, int]]:
    """(text, start) of the chunks of a section: about TARGET tokens of semantic text each, MAXIMUM at most, repeating up to OVERLAP tokens.

    Prose ends at a sentence where one ends in the last two fifths of a chunk, tables between rows. A single word over the limit is cut by
    halving. Token counts must not fall as text grows."""
    words = [(m.start(), m.end()) for m in re.finditer(r"\S+", text)]
    n = len(words)
    if not n:
        return []
    if table:
        ends = [i == n - 1 or "\n" in text[words[i][1] : words[i + 1][0]] for i in range(n)]
    else:
        ends = [ends_sentence(text[a:b]) for a, b in words]

    def begin(i: int) -> int:
        if table and (i == 0 or ends[i - 1]):
            return text.rfind("\n", 0, max(0, words[i][0])) + 1
        return words[i][0]

    def part(i: int, j: int) -> str:
        stop = words[j - 1][1]
        if table and ends[j - 1]:
            nl = text.find("\n", stop)
            stop = len(text) if nl < 0 else nl
        return text[begin(i) : stop]

    size = lambda i, j: count(semantic(part(i, j)))

    def first(i: int, low: int, test: Callable[[int], bool]) -> int:
        """The least end from ``low`` on for which a monotone test holds, n + 1 if none."""
        step, high = 32, low
        while high <= n and not test(high):
            low = high + 1
            high += step
            step *= 2
        high = min(high, n + 1)
        while low < high:
            mid = (low + high) // 2
            if mid > n or test(mid):
                high = mid
            else:
                low = mid + 1
        return low

    budget = OVERLAP + count("")
    out: list[tuple[str, int]] = []
    start, previous = 0, 0
    while start < n:
        end = min(first(start, start + 1, lambda j: size(start, j) >= TARGET), n)
        if size(start, end) > MAXIMUM or len(part(start, end)) > MAX_CHARS:
            end = max(start + 1, first(start, start + 1, lambda j: size(start, j) > MAXIMUM or len(part(start, j)) > MAX_CHARS) - 1)
        if end < n:
            floor = max(start, previous)
            back = next((j for j in range(end, floor, -1) if ends[j - 1]), None)
            if back and (table or size(start, back) >= TARGET * 3 // 5):
                end = back
        piece = part(start, end)
        if size(start, end) > MAXIMUM or len(piece) > MAX_CHARS:
            at = 0
            while at < len(piece):
                length = min(MAX_CHARS, len(piece) - at)
                while length > 1 and count(semantic(piece[at : at + length])) > MAXIMUM:
                    length //= 2
                out.append((piece[at : at + length], begin(start) + at))
                at += length
        else:
            out.append((piece, begin(start)))
        if end >= n:
            break
        previous = end
        low, high = start, end  # the earliest start whose text to the end fits the overlap
        while low < high:
            mid = (low + high) // 2
            if count(part(mid, end)) <= budget:
                high = mid
            else:
                low = mid + 1
        again = low
        if start < again < end and not ends[again - 1]:
            nxt = next((j for j in range(again, end) if ends[j - 1]), end)
            again = nxt if nxt < end else end if table else again
        start = end if again <= start else again
    return out


CHUNKS = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("start", T.LongType())]))


def chunks_column(text: Column, table: Column | None = None) -> Column:
    """Chunks of a text column as an array."""

    @F.pandas_udf(CHUNKS)
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, tables in parts:
            yield pd.Series([[{"text": c, "start": s} for c, s in chunk(t, bool(k))] if isinstance(t, str) else [] for t, k in zip(texts, tables)])

    return run(text, F.lit(False) if table is None else table)


# From blocks to passages


@dataclass(frozen=True)
class Block:
    """An extracted block of a content, in order."""

    text: str
    kind: str = "document"  # document, structure, page, slide, sheet, email_part, image_frame
    page: int | None = None
    sheet: str | None = None
    cell_range: str | None = None
    slide: int | None = None
    path: str | None = None
    email_part: str | None = None
    frame: int | None = None
    region: tuple[float, float, float, float] | None = None
    warning: str | None = None
    heading: str | None = None
    heading_path: tuple[str, ...] = ()
    key: str | None = None
    method: str = "NativeText"
    confidence: float | None = None
    boilerplate: bool = False

    @property
    def is_paragraph(self) -> bool:
        return self.kind == "structure" and (self.path or "").startswith("document/paragraph[")

    @property
    def flows(self) -> bool:
        p = self.path or ""
        if self.kind == "page":
            return bool(re.fullmatch(r"page\[\d+\]/block\[\d+\]", p))
        if self.kind == "image_frame":
            return bool(re.fullmatch(r"block\[\d+\]", p))
        html = bool(re.search(r"(?:^|/)html/block\[\d+\]$", p))
        return self.is_paragraph or html if self.kind == "structure" else html if self.kind == "email_part" else False

    @property
    def table(self) -> str | None:
        """Key of the table that the block is part of."""
        if self.kind == "sheet" and self.cell_range and not self.path:
            return f"{self.sheet}\x1fgrid"
        p = (self.path or "").lower()
        if ("/table[" in p or p.startswith("table[")) and not p.endswith("/caption"):
            return repr((self.kind, self.page, self.slide, self.sheet, self.email_part, self.frame, self.path))
        return None

    @property
    def captioned(self) -> str | None:
        p = self.path or ""
        return replace(self, path=p[: -len("/caption")]).table if p.lower().endswith("/caption") else None

    def boundary(self, merging: bool = False) -> str:
        if merging and self.flows:
            scope = {"page": f"page:{self.page}:blocks", "image_frame": f"image:{self.page}:{self.frame}:blocks", "email_part": f"email:{self.email_part}:html-body"}.get(self.kind)
            if scope is None:
                scope = "structure:document-body" if self.is_paragraph else "structure:" + re.sub(r"html/block\[\d+\]$", "html-body", self.path or "")
        elif self.kind == "structure":
            scope = "structure:document-body" if self.is_paragraph else f"structure:{self.path}"
        elif self.kind == "document":
            scope = "document"
        else:
            where = {"page": self.page, "slide": self.slide, "sheet": self.sheet, "email_part": self.email_part, "image_frame": f"{self.page}:{self.frame}"}[self.kind]
            scope = f"{self.kind}:{where}:part:{self.path}:{self.cell_range if self.kind == 'sheet' else ''}"
        return f"{scope}\x1fheading:{self.heading}"

    @property
    def section_boundary(self) -> str:
        where = {"page": self.page, "slide": self.slide, "sheet": self.sheet, "email_part": self.email_part, "image_frame": f"{self.page}:{self.frame}"}
        return f"{self.kind}:{where[self.kind]}" if self.kind in where else self.boundary()

    @property
    def shown(self) -> str:
        return for_display(self.text, table=self.table is not None)


def section_keys(blocks: Iterable[Block]) -> list[Block]:
    """:func:`assign_keys` for the blocks of one content."""
    seen: dict[str, int] = {}
    out, before, current = [], None, None
    for b in blocks:
        here = b.section_boundary
        if b.key:
            current = b.key
        elif here != before:
            current = f"{here}:occurrence:{seen.get(here, 0)}"
            seen[here] = seen.get(here, 0) + 1
        out.append(replace(b, key=current))
        before = here
    return out


def merge_places(a: Block, b: Block) -> Block:
    """a's place, widened to b's: first to last path, union of regions, all warnings."""
    if a.kind != b.kind:
        return a
    path = f"{a.path.split('..')[0]}..{b.path.split('..')[-1]}" if a.path and b.path and a.path != b.path else a.path
    if a.kind == "structure":
        return replace(a, path=path)
    if (a.page, a.frame, a.email_part) != (b.page, b.frame, b.email_part):
        return a
    region = None
    if a.region and b.region:
        (ax, ay, aw, ah), (bx, by, bw, bh) = a.region, b.region
        x, y = min(ax, bx), min(ay, by)
        region = (x, y, max(ax + aw, bx + bw) - x, max(ay + ah, by + bh) - y)
    warnings = [w for w in dict.fromkeys((a.warning, b.warning)) if w and w.strip()]
    return replace(a, path=path, region=region, warning=" ".join(warnings) or None)


@dataclass(frozen=True)
class Prepared:
    block: Block
    text: str
    first: int
    last: int
    boundary: str
    header: TableHeader | None = None
    caption: str | None = None


def prepare(blocks: Sequence[Block]) -> list[Prepared]:
    """Neighbouring fragments merged, tables with their headers and captions. Merged are flowing texts of one boundary, section, heading and
    method, of MERGED_WORDS together, if they are paragraphs or one is a fragment."""
    items = [(i, b, b.shown) for i, b in enumerate(blocks)]
    items = [x for x in items if x[2].strip()]
    headers: dict[str, TableHeader | None] = {}
    captions: dict[str, str] = {}
    for _, b, text in items:
        if b.captioned:
            captions.setdefault(b.captioned, for_search(text))
        if b.kind != "sheet" and b.table and b.table not in headers:
            headers[b.table] = parse_header(text)
    sheets: dict[str, list] = {}
    for i, b, text in items:
        if b.kind == "sheet" and b.cell_range and not b.path:
            sheets.setdefault(b.sheet or "", []).append((i, b.cell_range, text))
    grid = {i: ctx for rows in sheets.values() for (i, _, _), ctx in zip(rows, sheet_contexts([(r, t) for _, r, t in rows]))}
    out: list[Prepared] = []
    for i, b, text in items:
        here = b.boundary(merging=True)
        mergeable = b.table is None and b.kind != "sheet" and (b.kind != "structure" or b.flows)
        if out and mergeable:
            p = out[-1]
            a, n, m = p.block, len(p.text.split()), len(text.split())
            if n + m <= MERGED_WORDS and (b.is_paragraph or min(n, m) <= FRAGMENT_WORDS) and p.boundary == here and (a.key, a.boilerplate, a.method, a.heading) == (b.key, b.boilerplate, b.method, b.heading):
                conf = a.confidence if b.confidence is None else b.confidence if a.confidence is None else (a.confidence * len(p.text) + b.confidence * len(text)) / max(1, len(p.text) + len(text))
                out[-1] = replace(p, block=replace(merge_places(a, b), confidence=conf), text=f"{p.text}\n{text}", last=i)
                continue
        header, caption = grid[i] if i in grid else (headers.get(b.table), captions.get(b.table)) if b.table else (None, None)
        out.append(Prepared(b, text, i, i, here, header, caption))
    return out


def separated_markers(blocks: Sequence[Block], title: str | None = None) -> set[int]:
    """Blocks that are only a bullet whose item stands in a block to the right, with nothing to the left of it."""
    bullets = "•◦▪‣⁃"
    reliable = lambda b: b.warning is None and (b.method != "Ocr" or b.confidence is not None and 50 <= b.confidence <= 100)
    located: dict[tuple, list[int]] = {}
    for i, b in enumerate(blocks):
        r = b.region
        if b.kind in ("page", "image_frame") and r and r[0] >= 0 and r[1] >= 0 and r[2] > 0 and r[3] > 0 and r[0] + r[2] <= 1 and r[1] + r[3] <= 1 and "block[" in (b.path or "") and "table[" not in (b.path or ""):
            located.setdefault((b.kind, b.page, b.frame, b.key), []).append(i)
    out = set()
    for group in located.values():
        context = [i for i in group if not blocks[i].boilerplate and clean_body(blocks[i].text)]
        peers = [i for i in context if reliable(blocks[i]) and sum(c.isalpha() for c in blocks[i].text) >= 2]
        for i in group:
            b = blocks[i]
            text = for_search(b.text)
            x, y, w, h = b.region  # type: ignore[misc]
            if text not in bullets or not text or not reliable(b) or b.boilerplate or w > 5 * h or name_key(text) in (name_key(title), name_key(b.heading)):
                continue

            def level(j: int, y: float = y, h: float = h) -> bool:
                r = blocks[j].region
                return min(y + h, r[1] + r[3]) - max(y, r[1]) >= 0.5 * h  # type: ignore[index]

            if any(j != i and level(j) and blocks[j].region[0] < x and x - blocks[j].region[0] - blocks[j].region[2] <= 0.05 for j in context):  # type: ignore[index]
                continue
            if any(j != i and blocks[j].method == b.method and level(j) and -0.001 <= blocks[j].region[0] - x - w <= 0.05 for j in peers):  # type: ignore[index]
                out.add(i)
    return out


def deterministic_id(scope: str, kind: str, identity: str) -> str:
    """An id that depends on its scope, kind and identity only."""
    digest = bytearray(hashlib.sha256(f"{scope.replace('-', '')}\x1f{kind}\x1f{identity}".encode()).digest()[:16])
    digest[6] = digest[6] & 0x0F | 0x50
    digest[8] = digest[8] & 0x3F | 0x80
    return str(uuid.UUID(bytes_le=bytes(digest)))


def passages_of(blocks: Sequence[Block], content_id: str, file_name: str = "", title: str = "", subject: str = "", content_name: str = "", count: Callable[[str], int] = approximate_tokens) -> tuple[list[dict], list[dict]]:
    """Sections and passages of one content, with stable ids, offsets into the sections, and the text for embedding."""
    keyed = section_keys(blocks)
    markers = separated_markers(keyed, title)
    sections: dict[str, dict] = {}
    offsets: dict[int, int] = {}
    for i, b in enumerate(keyed):
        s = sections.setdefault(b.key or "", {"id": deterministic_id(content_id, "section", b.key or ""), "content_id": content_id, "ordinal": len(sections), "display_text": "", "heading": b.heading, "heading_path": list(b.heading_path), "section_kind": "heading" if b.heading_path else b.kind.replace("_", "")})
        text = b.shown
        if s["display_text"] and text:
            s["display_text"] += "\n"
        offsets[i] = len(s["display_text"])
        s["display_text"] += text
    passages: list[dict] = []
    for p in prepare(keyed):
        b = p.block
        mail = b.kind == "email_part" and b.email_part == "body"
        sign = signature_start(p.text, mail)
        references = b.kind == "sheet"
        body_of = lambda t: clean_body(linearize(t, p.header, references) if p.header else t, b.boilerplate, mail)  # noqa: E731, B023
        context = [("Title", title), ("Heading", b.heading), ("Table caption", p.caption), ("Sheet", b.sheet), ("Email subject", subject), ("Table headers", p.header.display if p.header else None), ("Content", content_name), ("Filename", file_name)]
        tail = compose("", context, count)  # cleaned bodies and composed contexts are in their search form already
        semantic = lambda t: f"{body_of(t)} {tail}".strip()  # noqa: E731, B023
        for k, (text, start) in enumerate(chunk(p.text, b.table is not None, semantic, count)):
            own = text if sign is None else "" if start >= sign else text[: sign - start]
            body = body_of(own)
            worth = bool(body) and not (p.first == p.last and p.first in markers) and not (b.method == "Ocr" and b.confidence is not None and b.confidence < MINIMUM_OCR) and (b.table is not None or sum(c.isalpha() for c in body) >= 2)
            where = "\x1f".join("" if v is None else str(v) for v in (b.kind, b.page, b.sheet, b.cell_range, b.slide, b.path, b.email_part, b.frame))
            passages.append({"id": deterministic_id(content_id, "passage", f"{p.first}:{p.last}:{where}:{k}"), "content_id": content_id, "ordinal": len(passages), "display_text": text, "semantic_text": semantic(own) if worth else "", "body_text": canonical(text),
                             "heading": b.heading, "section_id": sections[b.key or ""]["id"], "section_offset": offsets[p.first] + start, "semantic_eligible": worth, "extraction_method": b.method, "ocr_confidence": b.confidence})
    return list(sections.values()), passages
