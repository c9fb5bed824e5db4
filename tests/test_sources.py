import gzip
import io
import tarfile
import zipfile

import pytest

from strandex.sources import extract as X
from strandex.sources import formats


def opened(data, name):
    e = X.Extractor()
    node = e.file(data if isinstance(data, bytes) else data.encode(), name)
    return node, [p.code for p in e.problems]


def package(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name.replace("__", "/").replace("~", "."), body)
    return out.getvalue()


def zipped(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, b in entries:
            z.writestr(n, b)
    return out.getvalue()


def test_catalog():
    assert len(formats.BY_EXTENSION) == 56
    assert formats.resolve(b"  <!DOCTYPE html><p>", "a.txt") == (".html", "html")
    assert formats.resolve(b"%PDF-1.7", "a.txt") == (".pdf", "pdf")
    assert formats.resolve(b"x", "a.TAR.GZ") == (".tar.gz", "archive")
    assert formats.resolve(b"x", "noname", "text/json; charset=x") == (".json", "json")
    assert formats.resolve(b"x", "a.unknown") is None


@pytest.mark.parametrize("data, text", [(b"\xef\xbb\xbfhi", "hi"), ("é".encode("utf-16"), "é"), (b"\xfe\xff\x00h", "h"), ("é".encode(), "é"), (b"caf\xe9 \x80", "café €"), (b"", "")])
def test_decode(data, text):
    assert formats.decode(data) == text


def test_html():
    page = "<html><head><title>T</title><script>x()</script></head><body><nav>Menu</nav><h1>A</h1><p>one<br>two <b>bold</b></p><h2>B</h2><table><caption>Cap</caption><tr><th>x<th>y<tr><td colspan=2>1</table><h1>C</h1><img alt='pic'>end</body></html>"
    node, errors = opened(page, "a.html")
    got = [(b.text, b.heading_path, b.boilerplate, b.path) for b in node.blocks]
    assert not errors and node.title == "T"
    assert got[0] == ("Menu", (), True, "html/block[1]")
    assert [g[:2] for g in got[1:4]] == [("A", ("A",)), ("one\ntwo bold", ("A",)), ("B", ("A", "B"))]
    assert got[4][0] == "Cap" and got[4][3] == "html/table[1]/caption"
    assert got[5][0] == "x\ty\n1" and node.blocks[5].warning == X.SPANS
    assert got[6][:2] == ("C", ("C",)) and got[7][0] == "picend"


def test_markdown():
    node, _ = opened("# Head\n\ntext **bold** [link](u)\n\n- item\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n```\ncode <b>\n```\n<i>raw</i>\n", "a.md")
    assert [b.text for b in node.blocks] == ["Head", "text bold link", "item", "a\tb\n1\t2", "code <b>", "<i>raw</i>"]


def test_delimited():
    node, _ = opened('Depot,Item\n"a, ""b""",2\n,\n,x\n', "a.csv")
    assert [(b.text, b.cell_range) for b in node.blocks] == [("A: Depot\tB: Item", "A1:B1"), ('A: a, "b"\tB: 2', "A2:B2"), ("B: x", "B4")]
    assert opened("a\tb\n", "a.tsv")[0].blocks[0].sheet == "TSV"


def test_json():
    node, errors = opened('{"a": {"b c": [1.50, {}, "x"]}, // note\n "d": [], "e": null,}', "a.json")
    assert not errors and node.blocks[0].text == '$.a["b c"][0]: 1.50\n$.a["b c"][1]: {}\n$.a["b c"][2]: x\n$.d: []\n$.e: null'
    assert opened("{", "a.json")[1] == ["malformed_document"]
    lines = opened('{"a": 1}\n\nbroken\n', "a.jsonl")[0]
    assert [(b.text, b.path) for b in lines.blocks] == [("$.a: 1", "line[1]"), ("broken", "line[3]")]


def test_xml_and_rtf():
    node, _ = opened("<r xmlns:n='u' n:k='v'>t<c>in</c>u</r>", "a.xml")
    assert [(b.text, b.path) for b in node.blocks] == [("@k: v\ntu", "/r"), ("in", "/r/c")]
    assert opened("<!DOCTYPE r [<!ENTITY x 'y'>]><r>&x;</r>", "a.xml")[1] == ["malformed_document"]
    assert opened(r"{\rtf1\ansi{\fonttbl{\f0 Arial;}}{\*\x hidden}caf\'e9 \u8364?\par two\tab x}", "a.rtf")[0].blocks[0].text == "café €\ntwo\tx"


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def test_word():
    doc = f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="H"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>Body</w:t></w:r><w:r><w:t>text</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    rels = '<Relationships xmlns="r"><Relationship Id="1" Type="x/styles" Target="styles.xml"/><Relationship Id="2" Type="x/header" Target="header1.xml"/><Relationship Id="3" Type="x/package" Target="embeddings/in.txt"/></Relationships>'
    styles = f'<w:styles {W}><w:style w:styleId="H"><w:name w:val="heading 2"/></w:style></w:styles>'
    header = f"<w:hdr {W}><w:p><w:r><w:t>Top</w:t></w:r></w:p></w:hdr>"
    data = zipped([("word/document.xml", doc), ("word/_rels/document.xml.rels", rels), ("word/styles.xml", styles), ("word/header1.xml", header), ("word/embeddings/in.txt", "inner")])
    node, errors = opened(data, "a.docx")
    assert not errors
    assert [(b.text, b.heading, b.path) for b in node.blocks] == [("Head", "Head", "document/paragraph[1]"), ("Body text", "Head", "document/paragraph[2]"), ("a\tb", "Head", "document/table[1]"), ("Top", None, "header[1]")]
    assert node.blocks[3].boilerplate and node.children[0].blocks[0].text == "inner"
    assert X.materialise(data, "a.docx", [0]) == b"inner"


def test_spreadsheet():
    book = '<workbook xmlns="m" xmlns:r="r"><sheets><sheet name="One" r:id="1"/></sheets></workbook>'
    rels = '<Relationships><Relationship Id="1" Type="x/worksheet" Target="worksheets/s.xml"/><Relationship Id="2" Type="x/sharedStrings" Target="shared.xml"/><Relationship Id="3" Type="x/styles" Target="styles.xml"/></Relationships>'
    sheet = '<worksheet><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1"><v>60</v></c><c r="C1" s="1"><v>60</v></c></row><row><c r="B3"><f>A1*2</f></c><c r="C3" s="1"><v>45000.5</v></c><c r="D3" s="2"><v>1.5</v></c></row></sheetData></worksheet>'
    styles = '<styleSheet><numFmts><numFmt numFmtId="170" formatCode="[h]:mm:ss"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/></cellXfs></styleSheet>'
    data = zipped([("xl/workbook.xml", book), ("xl/_rels/workbook.xml.rels", rels), ("xl/worksheets/s.xml", sheet), ("xl/shared.xml", "<sst><si><t>Name</t></si></sst>"), ("xl/styles.xml", styles)])
    node, errors = opened(data, "a.xlsx")
    assert not errors and [(b.text, b.cell_range) for b in node.blocks] == [
        ("A1: Name\tB1: 60\tC1: 1900-02-29 (Excel 1900 leap-day) (Excel serial: 60)", "A1:C1"), ("B3: A1*2 (formula; no cached value)\tC3: 2023-03-15 (Excel serial: 45000.5)\tD3: 36:00:00 (Excel serial: 1.5)", "B3:D3")]


@pytest.mark.parametrize("raw, kind, old, want", [("59", (True, False, False), False, "1900-02-28"), ("61", (True, False, False), False, "1900-03-01"), ("0", (True, False, False), True, "1904-01-01"), ("0.25", (False, True, False), False, "06:00:00"), ("1.5", (True, True, False), False, "1900-01-01T12:00:00")])
def test_excel_dates(raw, kind, old, want):
    assert X.excel_date(raw, kind, old) == f"{want} (Excel serial: {raw})"


def test_excel_dates_left_alone():
    assert [X.excel_date(r, (True, False, False)) for r in ("-1", "0.5", "x", "1e99")] == ["-1", "0.5", "x", "1e99"]
    assert X.excel_format(170, {170: "0.00;-0.00"}) == (False, False, False) and X.excel_format(171, {171: '"d"0'}) == (False, False, False)


def test_presentation_and_open_document():
    slide = '<p:sld xmlns:p="p" xmlns:a="a"><p:sp><p:nvPr><p:ph type="title"/></p:nvPr><a:p><a:t>Title</a:t></a:p></p:sp><p:sp><a:p><a:t>Body</a:t></a:p></p:sp></p:sld>'
    data = zipped([("ppt/presentation.xml", '<p:presentation xmlns:p="p" xmlns:r="http://r"><p:sldId r:id="1" id="256"/></p:presentation>'), ("ppt/_rels/presentation.xml.rels", '<Relationships><Relationship Id="1" Type="x/slide" Target="slides/s1.xml"/></Relationships>'), ("ppt/slides/s1.xml", slide)])
    node, errors = opened(data, "a.pptx")
    assert not errors and [(b.text, b.slide, b.heading) for b in node.blocks] == [("Title\nBody", 1, "Title")]
    o, t, b = "urn:oasis:names:tc:opendocument:xmlns:office:1.0", "urn:text", "urn:table"
    text = f'<o:c xmlns:o="{o}" xmlns:t="{t}" xmlns:b="{b}"><o:body><o:text><t:h t:outline-level="1">H</t:h><t:p>a<t:s t:c="2"/>b</t:p></o:text></o:body></o:c>'
    assert [(x.text, x.heading) for x in opened(zipped([("content.xml", text)]), "a.odt")[0].blocks] == [("H", "H"), ("a  b", "H")]
    grid = f'<o:c xmlns:o="{o}" xmlns:t="{t}" xmlns:b="{b}"><o:body><o:spreadsheet><b:table b:name="S"><b:table-row b:number-rows-repeated="2"><b:table-cell/></b:table-row><b:table-row><b:table-cell b:number-columns-repeated="2"><t:p>x</t:p></b:table-cell></b:table-row></b:table></o:spreadsheet></o:body></o:c>'
    assert [(x.text, x.cell_range) for x in opened(zipped([("content.xml", grid)]), "a.ods")[0].blocks] == [("A3: x\tB3: x", "A3:B3")]


def test_epub():
    data = zipped([("META-INF/container.xml", "<c><rootfile full-path='o/p.opf'/></c>"), ("o/p.opf", "<package><metadata><title>Book</title></metadata><manifest><item id='b' href='two.xhtml'/><item id='a' href='one.xhtml'/></manifest><spine><itemref idref='a'/><itemref idref='b'/></spine></package>"), ("o/one.xhtml", "<html><body><h1>One</h1><p>first</p></body></html>"), ("o/two.xhtml", "<html><body><p>second</p></body></html>")])
    node, _ = opened(data, "a.epub")
    assert node.title == "Book" and [(b.text, b.path) for b in node.blocks] == [("One", "spine[1]/html/block[1]"), ("first", "spine[1]/html/block[2]"), ("second", "spine[2]/html/block[1]")]


MAIL = b"From: A <a@x>\r\nTo: b@x\r\nSubject: Hi\r\nDate: Tue, 02 Jan 2024 10:00:00 +0100\r\nMIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary=B\r\n\r\n--B\r\nContent-Type: text/plain\r\n\r\nBody here\r\n--B\r\nContent-Type: text/csv\r\nContent-Disposition: attachment; filename=t.csv\r\n\r\na,b\r\n--B--\r\n"


def test_mail():
    node, errors = opened(MAIL, "m.eml")
    assert not errors
    assert node.blocks[0].text.startswith("From: A <a@x>\nTo: b@x\nCc: \nDate: 2024-01-02T10:00:00.0000000+01:00\nSubject: Hi")
    assert node.blocks[1].text.strip() == "Body here" and node.blocks[1].email_part == "body"
    child = node.children[0]
    assert (child.name, child.relationship, child.blocks[0].text) == ("t.csv", "email-attachment", "A: a\tB: b")
    assert X.materialise(MAIL, "m.eml", [0]).strip() == b"a,b" and X.materialise(MAIL, "m.eml", [3]) is None


def test_archives_nest_and_fail_apart():
    inner = zipped([("deep.txt", "deep"), ("bad.json", "{")])
    tar = io.BytesIO()
    with tarfile.open(fileobj=tar, mode="w:gz") as t:
        info = tarfile.TarInfo("in.zip")
        info.size = len(inner)
        t.addfile(info, io.BytesIO(inner))
    node, errors = opened(tar.getvalue(), "a.tar.gz")
    assert node.children[0].children[0].blocks[0].text == "deep" and errors == ["malformed_document"]
    assert opened(gzip.compress(b"plain"), "b.txt.gz")[0].children[0].blocks[0].text == "plain"
    assert opened(b"junk", "a.zip")[1] == ["malformed_document"]
    assert opened(b"junk", "a.rar")[1] == ["unsupported_format"]
    deep = b"end"
    for n in range(8):
        deep = zipped([(f"l{n}.zip" if n else "x.txt", deep)])
    assert "nesting_limit" in opened(deep, "deep.zip")[1]


def test_files_as_frame(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "s" / "m.eml").write_bytes(MAIL)
    (tmp_path / "z.bin").write_bytes(b"\0")
    got = {r["path"].rsplit("/", 1)[-1]: r for r in X.extract_files(X.read_files(spark, str(tmp_path))).collect()}
    assert [b["text"] for b in got["a.csv"]["nodes"][0]["blocks"]] == ["A: x\tB: y", "A: 1\tB: 2"]
    assert [(n["name"], n["parent"], n["depth"]) for n in got["m.eml"]["nodes"]] == [("m.eml", None, 0), ("t.csv", 0, 1)]
    assert got["z.bin"]["errors"][0]["code"] == "unsupported_format"
    kinds = {r["path"].rsplit("/", 1)[-1]: r["k"] for r in X.read_files(spark, str(tmp_path)).select("path", formats.kind_column(*[__import__("pyspark.sql.functions", fromlist=["col"]).col(c) for c in ("path", "content")]).alias("k")).collect()}
    assert kinds == {"a.csv": "delimited", "m.eml": "eml", "z.bin": None}


def compound(tree):
    """A compound file of a tree of storages and streams, all small; sectors of 512 and 64 bytes."""
    import struct

    entries, streams = [], []

    def add(name, value):
        at = len(entries)
        entries.append(None)
        children = [add(k, v) for k, v in value.items()] if isinstance(value, dict) else []
        for a, b in zip(children, children[1:]):
            entries[a]["right"] = b
        entries[at] = {"name": name, "kind": 5 if at == 0 else 1 if isinstance(value, dict) else 2, "right": 0xFFFFFFFF, "child": children[0] if children else 0xFFFFFFFF, "start": 0xFFFFFFFE, "size": 0}
        if not isinstance(value, dict):
            start = sum(-(-len(x) // 64) for x in streams)
            entries[at] |= {"start": start if value else 0xFFFFFFFE, "size": len(value)}
            streams.append(value)
        return at

    add("Root Entry", tree)
    mini = b"".join(x + bytes(-len(x) % 64) for x in streams)
    links = [n for x in streams for n in [*range(1, -(-len(x) // 64)), 0xFFFFFFFE][: -(-len(x) // 64)]]
    base, table = 0, []
    for x in streams:
        k = -(-len(x) // 64)
        table += [base + i + 1 if i + 1 < k else 0xFFFFFFFE for i in range(k)]
        base += k
    assert len(links) == len(table)
    sector = lambda b: b + bytes(-len(b) % 512)
    mini_table = sector(struct.pack(f"<{len(table)}I", *table) + b"\xff" * (-len(table) * 4 % 512))
    mini = sector(mini)
    entries[0] |= {"start": 0, "size": len(mini)}
    raw = b""
    n_mini, n_table = len(mini) // 512, len(mini_table) // 512
    entries[0]["start"] = 0
    for e in entries:
        name = e["name"].encode("utf-16-le") + b"\0\0"
        raw += name + bytes(64 - len(name)) + struct.pack("<HBBIII", len(name), e["kind"], 1, 0xFFFFFFFF, e["right"], e["child"]) + bytes(36) + struct.pack("<IQ", e["start"], e["size"])
    raw = sector(raw)
    parts = [mini, mini_table, raw]
    fat, at = [], 0
    for part in parts:
        k = len(part) // 512
        fat += [at + i + 1 if i + 1 < k else 0xFFFFFFFE for i in range(k)]
        at += k
    fat += [0xFFFFFFFD] + [0xFFFFFFFF] * (127 - len(fat))
    assert len(fat) == 128
    head = bytes.fromhex("d0cf11e0a1b11ae1") + bytes(16) + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + bytes(6) + struct.pack("<IIIIIIIIII", 0, 1, n_mini + n_table, 0, 4096, n_mini, n_table, 0xFFFFFFFE, 0, at) + b"\xff" * 432
    return head[:512] + b"".join(parts) + struct.pack("<128I", *fat)


def outlook(subject, body, extra=None, head=32):
    import struct

    wide = lambda t: t.encode("utf-16-le")
    when = struct.pack("<IIQ", 0x00390040, 0, 133_485_408_000_000_000)
    return {"__substg1.0_0037001F": wide(subject), "__substg1.0_1000001F": wide(body), "__substg1.0_0C1A001F": wide("Ann Lee"), "__substg1.0_5D01001F": wide("ann@x.example"), "__properties_version1.0": bytes(head) + when,
            "__recip_version1.0_#00000000": {"__substg1.0_3001001F": wide("Bob Ray"), "__substg1.0_39FE001F": wide("bob@y.example"), "__properties_version1.0": bytes(8) + struct.pack("<IIQ", 0x0C150003, 0, 1)}} | (extra or {})


def test_outlook_messages():
    wide = lambda t: t.encode("utf-16-le")
    inner = outlook("Inner", "The inner text.", head=24)
    tree = outlook("Grüße", "The pump leaks.\r\nPlease come.", {
        "__attach_version1.0_#00000000": {"__substg1.0_3707001F": wide("note.txt"), "__substg1.0_37010102": b"A note.", "__substg1.0_370E001F": wide("text/plain")},
        "__attach_version1.0_#00000001": {"__substg1.0_3001001F": wide("Forwarded"), "__substg1.0_3701000D": inner}})
    data = compound(tree)
    node = X.Extractor().file(data, "mail.msg")
    assert node.status == "ready" and [b.text for b in node.blocks] == ["From: Ann Lee <ann@x.example>\nTo: Bob Ray <bob@y.example>\nCc: \nDate: 2024-01-01T00:00:00.0000000+00:00\nSubject: Grüße", "The pump leaks.\nPlease come.\n"]
    assert [(c.name, c.relationship, c.status) for c in node.children] == [("note.txt", "email-attachment", "ready"), ("Forwarded.eml", "email-attachment", "ready")]
    assert node.children[1].blocks[1].text.strip() == "The inner text."
    assert X.materialise(data, "mail.msg", [0]).strip() == b"A note."
    for bad in (data[:700], data[:8] + bytes(600), compound({"Other": b"x"})):
        e = X.Extractor()
        assert e.file(bad, "mail.msg").status == "error" and e.problems[0].code == "malformed_document"


def pdf(contents, font=b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /FirstChar 32 /Widths [250] >>", extra=(), compress=True, trailer=b""):
    import zlib

    kids = b" ".join(b"%d 0 R" % (10 + 2 * i) for i in range(len(contents)))
    parts = [b"1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj", b"2 0 obj << /Type /Pages /Count %d /MediaBox [0 0 600 800] /Resources << /Font << /F1 3 0 R >> >> /Kids [%s] >> endobj" % (len(contents), kids), b"3 0 obj " + font + b" endobj", *extra]
    for i, c in enumerate(contents):
        body = zlib.compress(c) if compress else c
        parts.append(b"%d 0 obj << /Type /Page /Parent 2 0 R /Contents %d 0 R >> endobj" % (10 + 2 * i, 11 + 2 * i))
        parts.append(b"%d 0 obj << /Length %d %s>> stream\n" % (11 + 2 * i, len(body), b"/Filter /FlateDecode " if compress else b"") + body + b"\nendstream endobj")
    return b"%PDF-1.4\n" + b"\n".join(parts) + b"\ntrailer << /Root 1 0 R " + trailer + b">>\n%%EOF"


def test_pdf_text():
    one = b"BT /F1 12 Tf 14 TL 50 700 Td (The pump \\(new\\) leaks) Tj T* [(ev) -50 (ery) -300 (month.)] TJ ET BT /F1 12 Tf 50 400 Td (Second part.) Tj ET"
    node = X.Extractor().file(pdf([one, b"q 1 0 0 1 0 0 cm Q"]), "a.pdf")
    assert node.status == "ready" and [(b.page, b.text, b.warning) for b in node.blocks] == [(1, "The pump (new) leaks\nevery month.", None), (1, "Second part.", None), (2, "", "no_text")]
    x, y, w, h = node.blocks[0].region
    assert abs(x - 50 / 600) < 0.01 and 0.09 < y < 0.13 and w > 0.1 and h > 0.02


def test_pdf_fonts_forms_and_columns():
    names = b"1 beginbfrange <0001> <0003> <0041> endbfrange 1 beginbfchar <0005> <00FC> endbfchar"
    font = b"<< /Type /Font /Subtype /Type0 /DescendantFonts [4 0 R] /ToUnicode 5 0 R >>"
    extra = [b"4 0 obj << /Type /Font /DW 600 /W [1 [500 500]] >> endobj", b"5 0 obj << /Length %d >> stream\n" % len(names) + names + b"\nendstream endobj"]
    node = X.Extractor().file(pdf([b"BT /F1 10 Tf 1 0 0 1 50 700 Tm <00010002000300050001> Tj ET"], font, extra, False), "a.pdf")
    assert [b.text for b in node.blocks] == ["ABCüA"]
    left = b" ".join(b"BT /F1 10 Tf 40 %d Td (left %d goes on and on) Tj ET" % (700 - 14 * i, i) for i in range(6))
    right = b" ".join(b"BT /F1 10 Tf 340 %d Td (right %d goes on and on) Tj ET" % (700 - 14 * i, i) for i in range(6))
    text = "\n".join(b.text for b in X.Extractor().file(pdf([left + b" " + right]), "a.pdf").blocks)
    assert text.index("left 5") < text.index("right 0")


@pytest.mark.parametrize("data, code", [(pdf([b""], trailer=b"/Encrypt 9 0 R "), "encrypted_document"), (b"%PDF-1.4 nothing", None), (b"%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 1 0 R >> endobj", None), (pdf([b"BT /F1 (x Tj [ << "]), None), (pdf([b"BT 1 Tf (a) TJ 1 2 Tm Q Q ET"]), None)])
def test_pdf_faults(data, code):
    e = X.Extractor()
    node = e.file(data, "a.pdf")
    assert [p.code for p in e.problems] == ([code] if code else []) and node.status == ("error" if code else "ready")
