"""Which format a file has: by its first bytes, its name, or its declared type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_OPEN = "application/vnd.openxmlformats-officedocument."
_ODF = "application/vnd.oasis.opendocument."
#: Extensions, media types and kinds of the formats (fixed values): kind, then ``extension media-type other-names…`` on a line each.
_CATALOG = f"""
pdf
.pdf application/pdf
word
.docx {_OPEN}wordprocessingml.document
.docm application/vnd.ms-word.document.macroenabled.12
.dotx {_OPEN}wordprocessingml.template
.dotm application/vnd.ms-word.template.macroenabled.12
spreadsheet
.xlsx {_OPEN}spreadsheetml.sheet
.xlsm application/vnd.ms-excel.sheet.macroenabled.12
.xltx {_OPEN}spreadsheetml.template
.xltm application/vnd.ms-excel.template.macroenabled.12
presentation
.pptx {_OPEN}presentationml.presentation
.pptm application/vnd.ms-powerpoint.presentation.macroenabled.12
.ppsx {_OPEN}presentationml.slideshow
.ppsm application/vnd.ms-powerpoint.slideshow.macroenabled.12
.potx {_OPEN}presentationml.template
.potm application/vnd.ms-powerpoint.template.macroenabled.12
odt
.odt {_ODF}text
ods
.ods {_ODF}spreadsheet
odp
.odp {_ODF}presentation
rtf
.rtf application/rtf text/rtf
text
.txt text/plain
.log text/plain
.rst text/x-rst
.adoc text/asciidoc
.tex application/x-tex
.yaml application/yaml text/yaml application/x-yaml text/x-yaml
.yml application/yaml
.toml application/toml
markdown
.md text/markdown
.markdown text/markdown
delimited
.csv text/csv
.tsv text/tab-separated-values
json
.json application/json text/json
jsonl
.jsonl application/x-ndjson application/jsonl application/ndjson
xml
.xml application/xml text/xml
html
.html text/html
.htm text/html
mhtml
.mht multipart/related application/x-mimearchive
.mhtml multipart/related
epub
.epub application/epub+zip
image
.png image/png
.jpg image/jpeg
.jpeg image/jpeg
.bmp image/bmp image/x-ms-bmp
.gif image/gif
.webp image/webp
.tif image/tiff
.tiff image/tiff
eml
.eml message/rfc822
msg
.msg application/vnd.ms-outlook
archive
.zip application/zip application/x-zip application/x-zip-compressed
.rar application/vnd.rar application/x-rar application/x-rar-compressed
.7z application/x-7z-compressed
.tar application/x-tar
.gz application/gzip application/x-gzip
.tgz application/gzip
.tar.gz application/gzip
"""


def _read() -> tuple[dict[str, tuple[str, str]], dict[str, str]]:
    by_extension, by_type, kind = {}, {}, ""
    for line in _CATALOG.split("\n"):
        if line.startswith("."):
            ext, *types = line.split()
            by_extension[ext] = (types[0], kind)
            for t in types:
                by_type.setdefault(t, ext)
        elif line:
            kind = line
    return by_extension, by_type


BY_EXTENSION, BY_TYPE = _read()
#: First characters of an HTML file (fixed values).
HTML_STARTS = ("<!doctype html", "<html", "<head", "<body")
SNIFFED = 512


def extension_of(name: str) -> str | None:
    low = name.replace("\\", "/").rsplit("/", 1)[-1].lower()
    for e in sorted((e for e in BY_EXTENSION if e.count(".") > 1), key=len, reverse=True):
        if low.endswith(e):
            return e
    dot = low.rfind(".")
    return low[dot:] if dot >= 0 and low[dot + 1 :].strip() else None


def resolve(data: bytes, name: str, media_type: str | None = None) -> tuple[str, str] | None:
    """(extension, kind), from the first bytes for HTML and PDF, else from the name, else from the declared type."""
    start = data[:SNIFFED].decode("utf-8", "replace").lstrip("﻿\0 \t\r\n").lower()
    if start.startswith(HTML_STARTS):
        return ".html", "html"
    if data.startswith(b"%PDF-"):
        return ".pdf", "pdf"
    ext = extension_of(name)
    if ext not in BY_EXTENSION:
        ext = BY_TYPE.get((media_type or "").split(";")[0].strip().lower())
    return (ext, BY_EXTENSION[ext][1]) if ext else None


def decode(data: bytes) -> str:
    """Text by its byte order mark, else UTF-8 where valid, else Windows-1252."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe\0\0", "utf-32-le"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if data.startswith(mark):
            return data[len(mark) :].decode(name, "replace")
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in data) if any(b in data for b in (0x81, 0x8D, 0x8F, 0x90, 0x9D)) else data.decode("cp1252")


def kind_column(path: Column, content: Column) -> Column:
    """The kind of a file as a column: first bytes, then extension; null where unknown."""
    start = F.lower(F.regexp_replace(F.decode(F.substring(content, 1, SNIFFED), "UTF-8"), r"^[\x{FEFF}\x{0}\s]+", ""))
    html = F.lit(False)
    for s in HTML_STARTS:
        html = html | start.startswith(s)
    low = F.lower(F.regexp_extract(path, r"([^/\\]*)$", 1))
    ext = F.when(low.endswith(".tar.gz"), ".tar.gz").otherwise(F.regexp_extract(low, r"(\.[^.]*)$", 1))
    table = F.create_map(*[F.lit(x) for e, (_, k) in BY_EXTENSION.items() for x in (e, k)])
    return F.when(html, "html").when(F.hex(F.substring(content, 1, 5)) == b"%PDF-".hex().upper(), "pdf").otherwise(table[ext])
