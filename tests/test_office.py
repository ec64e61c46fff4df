import io
import zipfile

import pytest

from veilframe.operators.rules import BY_SOURCE
from veilframe.publish import exit_code, mask_folder, restore_folder, summary
from veilframe.sources import office
from veilframe.sources.documents import read_documents, read_notes
from veilframe.sources.office import Package, PackageError

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
CORE = '<cp:coreProperties xmlns:cp="c" xmlns:dc="d"><dc:title>Per a.b@x.it</dc:title><dc:creator>Mario Verdini</dc:creator></cp:coreProperties>'


def zipped(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in parts.items():
            z.writestr(name.replace("__", "/"), data)
    return out.getvalue()


def cell(*paragraphs, span=""):
    return f"<w:tc><w:tcPr>{span}</w:tcPr>" + "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs) + "</w:tc>"


def docx(**more):
    body = (
        '<w:p><w:pPr><w:tabs><w:tab w:pos="1"/></w:tabs></w:pPr><w:r><w:t>scrivi a a.</w:t></w:r><w:r><w:t>b@x.</w:t><w:t>it</w:t><w:tab/><w:t>ora</w:t></w:r>'
        '<w:ins w:author="Anna" w:initials="A"><w:r><w:t>!</w:t></w:r></w:ins><w:del><w:r><w:delText>c@y.it</w:delText></w:r></w:del>'
        '<w:r><w:instrText>MAILTO d@z.it</w:instrText></w:r></w:p><w:p><w:r><w:tab/></w:r></w:p>'
        f"<w:tbl><w:tr>{cell('Nota', span='<w:gridSpan w:val="2"/>')}{cell('Nome')}</w:tr><w:tr>{cell('uno')}{cell('due')}{cell('Zorp Quux')}</w:tr></w:tbl>"
    )
    rels = '<Relationships xmlns="x"><Relationship Id="1" Type="t" TargetMode="External" Target="mailto:e@w.it"/><Relationship Id="2" Type="t" Target="styles.xml"/></Relationships>'
    return zipped(**{
        "word/document.xml": f'<?xml version="1.0"?><w:document {W}><w:body>{body}</w:body></w:document>', "word/_rels/document.xml.rels": rels, "docProps/core.xml": CORE,
        "word/media/i.png": b"\x00", "word/styles.xml": "<a>  kept  </a>", "docProps/thumbnail.jpeg": b"1",
    } | more)


def xlsx():
    shared = "<si><t>Nome</t></si><si><r><t>Zorp </t></r><r><t>Quux</t></r><rPh><t>zoop</t></rPh></si><si><t>f@v.it</t></si>"
    rows = (
        '<row r="2"><c r="B2" t="s"><v>0</v></c></row><row r="3"><c r="B3" t="s"><v>1</v></c><c r="C3" t="s"><v>2</v></c><c r="D3"><v>123456789</v></c></row>'
        '<row r="4"><c r="B4" t="s"><v>1</v></c><c r="C4" t="str"><f>HYPERLINK("mailto:g@u.it")</f><v>g@u.it</v></c><c t="inlineStr"><is><t>h@t.it</t></is></c></row>'
    )
    return zipped(**{
        "xl/workbook.xml": f'<workbook {S}><fileSharing userName="Anna"/><sheets><sheet name="i@s.it" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="x"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>', "xl/sharedStrings.xml": f"<sst {S}>{shared}</sst>",
        "xl/worksheets/sheet1.xml": f'<worksheet {S}><sheetData>{rows}</sheetData><hyperlinks><hyperlink display="l@p.it"/></hyperlinks><headerFooter><oddHeader>m@o.it</oddHeader></headerFooter></worksheet>',
        "xl/comments1.xml": f"<comments {S}><authors><author>Anna</author></authors><commentList><comment><text><r><t>n@n.it</t></r></text></comment></commentList></comments>",
    })


def texts(package):
    return {s.name.split(":", 1)[1] if "document" in s.name and "rels" not in s.name else s.name: s.text for s in package.segments}


def test_word_segments_and_edits():
    p = Package(".docx", docx())
    got = texts(p)
    assert got["p0:text"] == "scrivi a a.b@x.it\tora!" and got["p0:deleted"] == "c@y.it" and got["p0:field"] == "MAILTO d@z.it" and "p1:text" not in got
    assert got["word/_rels/document.xml.rels:Relationship0@Target"] == "mailto:e@w.it" and [s.text for s in p.segments if s.column_kind] == ["Zorp Quux"]
    assert p.notes == [("not read: media", 1, "")]
    again = p.written({"word/document.xml:p0:text": [(9, 18, "[X_1]"), (0, 6, "di")]})
    q = Package(".docx", again)
    assert texts(q)["p0:text"] == "di a [X_1]ora!" and b"Anna" not in zipfile.ZipFile(io.BytesIO(again)).read("word/document.xml")
    z = zipfile.ZipFile(io.BytesIO(again))
    assert z.read("word/styles.xml") == b"<a>  kept  </a>" and "docProps/thumbnail.jpeg" not in z.namelist() and b"Verdini" not in z.read("docProps/core.xml")
    with pytest.raises(ValueError):
        Package(".docx", docx()).written({"word/document.xml:p0:text": [(0, 5, "a"), (4, 6, "b")]})


def test_excel_segments_and_edits():
    p = Package(".xlsx", xlsx())
    got = {s.name: s for s in p.segments}
    name = got["xl/sharedStrings.xml:si1"]
    assert name.text == "Zorp Quux" and name.column_kind == "PERSON" and got["xl/sharedStrings.xml:si0"].column_kind is None
    assert p.notes == [("numeric identifiers", 1, "i@s.it!D3")]
    assert {"f@v.it", "g@u.it", "h@t.it", "i@s.it", "l@p.it", "m@o.it", "n@n.it", "zoop"} <= {s.text for s in p.segments}
    again = Package(".xlsx", p.written({"xl/sharedStrings.xml:si1": [(0, 9, "[PERSON_1]")], "xl/workbook.xml:sheet0@name": [(0, 6, "[EMAIL_1]")]}))
    assert {s.name: s.text for s in again.segments}.items() >= {"xl/sharedStrings.xml:si1": "[PERSON_1]", "xl/workbook.xml:sheet0@name": "EMAIL_1"}.items()
    assert "zoop" not in {s.text for s in again.segments}


def test_unsafe_packages(monkeypatch):
    doctype = '<!DOCTYPE a [<!ENTITY b "c">]><a>&b;</a>'
    for bad in (b"no zip", zipped(a="b"), docx(**{"word/document.xml": "<a>"}), docx(**{"word/document.xml": doctype})):
        with pytest.raises(PackageError):
            Package(".docx", bad)
    monkeypatch.setattr(office, "LARGEST", 10)
    with pytest.raises(PackageError):
        Package(".docx", docx())


def everything(path):
    with zipfile.ZipFile(path) as z:
        return b"".join(z.read(n) for n in z.namelist())


def test_folder_masked_and_restored(tmp_path, spark):
    source, out, back = tmp_path / "in", tmp_path / "out", tmp_path / "back"
    for folder in (source, out, back):
        folder.mkdir()
    (source / "a.docx").write_bytes(docx())
    (source / "b.xlsx").write_bytes(xlsx())
    (source / "c.txt").write_bytes("﻿a.b@x.it è qui\r\n".encode())
    (source / "d.docx").write_bytes(b"broken")
    rules = (BY_SOURCE["email"],)
    dry = mask_folder(spark, str(source), str(out), rules=rules, dry_run=True)
    assert dry.mapping.count() > 5 and not list(out.iterdir())
    got = mask_folder(spark, str(source), str(out), rules=rules)
    assert sorted(p.name for p in out.iterdir()) == ["a.anon.docx", "b.anon.xlsx", "c.anon.txt"]
    assert [r.path.split("/")[-1] for r in got.unread.collect()] == ["d.docx"]
    assert {r.path.split("/")[-1]: r.status for r in got.files.collect()} == {"a.docx": "masked", "b.xlsx": "masked", "c.txt": "masked", "d.docx": "error"} and exit_code(got.files) == 1
    for name in ("a.anon.docx", "b.anon.xlsx"):
        held = everything(out / name)
        assert b"@" not in held.replace(b"@Target", b"") and b"Quux" not in held
    assert (out / "c.anon.txt").read_bytes().startswith(b"\xef\xbb\xbf[EMAIL_")
    assert {r.note for r in read_notes(spark, str(source)).collect()} == {"not read: media", "numeric identifiers"}
    restore_folder(spark, str(out), str(back), got.mapping)
    rows = lambda folder, results: {(r.path.split("/")[-1].split(".")[0], r.turn): r.text for r in read_documents(spark, str(folder), results=results).where("error is null").collect()}
    before, after = rows(source, False), rows(back, True)
    assert (back / "c.anon.restored.txt").read_bytes() == (source / "c.txt").read_bytes()
    assert {t for t in before.values() if "@" in t and "\t" not in t} <= set(after.values())


def test_leaks_are_not_published(tmp_path, spark):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir(), out.mkdir()
    (source / "c.txt").write_text("a.b@x.it e Acme Uno")
    rules, allowed = (BY_SOURCE["email"],), spark.createDataFrame([("a.b@x.it",)], "value string")
    known = spark.createDataFrame([("AZIENDA", 1, "Uno", True)], "kind string, number bigint, value string, case_sensitive boolean")
    got = mask_folder(spark, str(source), str(out), known, rules=rules, propagate=False, first_names=None)
    assert [(r.name, r.text) for r in got.leaks.collect()] == [("c.anon.txt", "Uno")] and not list(out.iterdir())
    assert exit_code(got.files) == 2 and {r.status: r["count"] for r in summary(got.files).collect()} == {"blocked": 1, "masked": 0, "dry-run": 0, "skipped": 0, "error": 0}
    mask_folder(spark, str(source), str(out), known, rules=rules, propagate=False, first_names=None, force=True)
    assert "Acme Uno" in (out / "c.anon.txt").read_text()
    mask_folder(spark, str(source), str(out), rules=rules, allowlist=allowed, first_names=None)
    assert "a.b@x.it" in (out / "c.anon.txt").read_text()
