"""Word and Excel packages: their texts as segments, and copies with edited texts.

A segment is a run of pieces, each the text of a node or the value of an attribute, with tabs
and breaks as pieces that have no text of their own.  An edit puts its replacement where its
first written character stood and empties the rest, so formatting around it stays.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from xml.dom import minidom
from xml.parsers import expat

from veilframe.functions.folding import folded
from veilframe.functions.words import TITLES

#: Largest unpacked part that is read, in bytes.
LARGEST = 256 << 20
REQUIRED = {".docx": "word/document.xml", ".xlsx": "xl/workbook.xml"}
_WORD = re.compile(r"word/((document|header\d*|footer\d*|footnotes|endnotes|comments|glossary/document)\.xml)$")
_CUSTOM = re.compile(r"customXml/item\d+\.xml$")
_SHEET = re.compile(r"xl/worksheets/[^/]+\.xml$")
_COMMENTS = re.compile(r"xl/(comments[^/]*|comments/[^/]+)\.xml$")
_THREADS = re.compile(r"xl/threadedComments/[^/]+\.xml$")
_TABLE = re.compile(r"xl/tables/[^/]+\.xml$")
_PEOPLE = re.compile(r"(word/people|xl/persons/[^/]+)\.xml$")
# Property fields that are searched, and those that are emptied.
SEARCHED = {"title", "subject", "description", "keywords", "category", "contentStatus", "lpstr", "lpwstr"}
EMPTIED = {"creator", "lastModifiedBy", "Company", "Manager", "HyperlinkBase"}
HEADERS = ("oddHeader", "oddFooter", "evenHeader", "evenFooter", "firstHeader", "firstFooter")
#: Folders whose content is not read; they are counted.
UNREAD = ("media", "embeddings", "charts", "diagrams", "pivotCache", "pivotTables", "externalLinks", "queryTables", "connections.xml", "vbaProject.bin", "drawings")
_KIND_OF = {label: kind for kind, labels in TITLES.items() for label in labels.split("|")}
_HEADER_ROWS = 20


class PackageError(ValueError):
    """A file that is no package of the kind its ending names, or that is not safe to read."""


def bare(text: str) -> str:
    """Without brackets, which names and formulas must not hold."""
    return text.replace("[", "").replace("]", "")


def title_kind(label: str) -> str | None:
    return _KIND_OF.get(re.sub("[^a-z0-9]+", " ", folded(label)[0]).strip())


@dataclass(eq=False)
class Piece:
    node: minidom.Node
    name: str | None = None  # of an attribute
    sign: str = ""  # of a tab or break

    def get(self) -> str:
        if self.sign:
            return self.sign
        if self.name:
            return self.node.getAttribute(self.name)
        return "".join(x.data for x in self.node.childNodes if x.nodeType in (x.TEXT_NODE, x.CDATA_SECTION_NODE))

    def put(self, text: str) -> None:
        if self.name:
            self.node.setAttribute(self.name, text)
            return
        for x in list(self.node.childNodes):
            if x.nodeType in (x.TEXT_NODE, x.CDATA_SECTION_NODE):
                self.node.removeChild(x)
        self.node.appendChild(self.node.ownerDocument.createTextNode(text))
        if self.node.localName in ("t", "delText", "instrText") and text != text.strip():
            self.node.setAttribute("xml:space", "preserve")


@dataclass(eq=False)
class Segment:
    name: str
    pieces: list[Piece]
    change: Callable[[str], str] | None = None  # of replacements
    after: Callable[[], None] | None = None  # once edited
    column_kind: str | None = None

    @property
    def text(self) -> str:
        return "".join(p.get() for p in self.pieces)

    def edit(self, edits: list[tuple[int, int, str]]) -> None:
        """Replaces disjoint places of the text."""
        texts, starts, at = [p.get() for p in self.pieces], [], 0
        for text in texts:
            starts.append(at)
            at += len(text)
        limit = at
        for start, end, new in sorted(edits, reverse=True):
            if not 0 <= start < end <= limit:
                raise ValueError(f"{self.name}: edits overlap or leave the text")
            limit, new = start, self.change(new) if self.change else new
            for i, piece in enumerate(self.pieces):
                low, high = max(start - starts[i], 0), min(end - starts[i], len(texts[i]))
                if low >= high:
                    continue
                if piece.sign:
                    texts[i] = ""
                else:
                    texts[i], new = texts[i][:low] + new + texts[i][high:], ""
            if new:
                raise ValueError(f"{self.name}: no character to put a replacement in")
        for piece, text in zip(self.pieces, texts):
            if piece.sign and not text:
                piece.node.parentNode.removeChild(piece.node)
            elif not piece.sign and text != piece.get():
                piece.put(text)
        if self.after:
            self.after()


def _parsed(data: bytes, name: str) -> minidom.Document:
    def refuse(*_):
        raise PackageError(f"{name}: declares a document type")

    try:
        first = expat.ParserCreate()
        first.StartDoctypeDeclHandler = refuse
        first.Parse(data, True)
        return minidom.parseString(data)
    except expat.ExpatError as e:
        raise PackageError(f"{name}: not well-formed") from e


def _children(node: minidom.Node, *names: str) -> list[minidom.Element]:
    return [x for x in node.childNodes if x.nodeType == x.ELEMENT_NODE and (not names or x.localName in names)]


def _below(node: minidom.Node, *names: str, past: tuple[str, ...] = ()) -> Iterator[minidom.Element]:
    """Descendants by name in document order, not looking into elements named in ``past``."""
    pending = _children(node)[::-1]
    while pending:
        x = pending.pop()
        if not names or x.localName in names:
            yield x
        if x.localName not in past:
            pending += _children(x)[::-1]


def _word(node: minidom.Element) -> bool:
    return "wordprocessingml" in (node.namespaceURI or "")


def _number(text: str, other: int) -> int:
    return int(text) if re.fullmatch("[0-9]{1,6}", text) and int(text) else other


@dataclass
class Package:
    suffix: str
    content: bytes
    parts: dict[str, minidom.Document] = field(default_factory=dict)
    segments: list[Segment] = field(default_factory=list)
    notes: list[tuple[str, int, str]] = field(default_factory=list)

    def __post_init__(self) -> None:
        try:
            with zipfile.ZipFile(io.BytesIO(self.content)) as z:
                names = z.namelist()
                if REQUIRED[self.suffix] not in names:
                    raise PackageError(f"no {REQUIRED[self.suffix]}")
                for name in names:
                    if self._wanted(name):
                        if z.getinfo(name).file_size > LARGEST:
                            raise PackageError(f"{name}: over {LARGEST} bytes")
                        self.parts[name] = _parsed(z.read(name), name)
        except (zipfile.BadZipFile, NotImplementedError, RuntimeError, EOFError) as e:
            raise PackageError("no readable package") from e
        for name, part in self.parts.items():
            self._collect(name, part)
        if self.suffix == ".xlsx":
            self._sheets()
        unread = Counter(next((u for u in UNREAD if f"/{u}" in f"/{n}"), None) for n in names if not n.endswith(("/", ".rels")))
        self.notes += sorted((f"not read: {u}", count, "") for u, count in unread.items() if u)

    def _wanted(self, name: str) -> bool:
        if name.endswith(".rels") or name.startswith("docProps/") and name.endswith(".xml") or _CUSTOM.match(name) or _PEOPLE.match(name):
            return True
        if self.suffix == ".docx":
            return bool(_WORD.match(name))
        return name in ("xl/workbook.xml", "xl/sharedStrings.xml") or any(r.match(name) for r in (_SHEET, _COMMENTS, _THREADS, _TABLE))

    def _add(self, name: str, pieces: list[Piece], **more) -> Segment | None:
        """Segments that hold nothing written are left out."""
        made = Segment(name, pieces, **more)
        if not made.text.strip() or not any(p.get() for p in pieces if not p.sign):
            return None
        self.segments.append(made)
        return made

    def _attributes(self, part: str, nodes: Iterator[minidom.Element], names: tuple[str, ...], change: Callable | None = None) -> None:
        for n, node in enumerate(nodes):
            for name in names:
                self._add(f"{part}:{node.localName}{n}@{name}", [Piece(node, name)], change=change)

    def _collect(self, name: str, part: minidom.Document) -> None:
        if name.endswith(".rels"):
            self._attributes(name, (x for x in _below(part, "Relationship") if x.getAttribute("TargetMode") == "External"), ("Target",))
        elif name.startswith("docProps/"):
            for n, x in enumerate(_below(part)):
                if x.localName in SEARCHED and not _children(x):
                    listed = getattr(x.parentNode.parentNode, "localName", None) == "TitlesOfParts"
                    self._add(f"{name}:{x.localName}{n}", [Piece(x)], change=bare if listed and self.suffix == ".xlsx" else None)
        elif _CUSTOM.match(name):
            for n, x in enumerate(_below(part)):
                if not _children(x):
                    self._add(f"{name}:leaf{n}", [Piece(x)])
        elif _WORD.match(name):
            self._paragraphs(name, part)
        elif name == "xl/sharedStrings.xml":
            for n, x in enumerate(_below(part, "si")):
                self._rich(f"{name}:si{n}", x)
        elif name == "xl/workbook.xml":
            self._attributes(name, _below(part, "sheet"), ("name",), bare)
            for n, x in enumerate(_below(part, "definedName")):
                self._add(f"{name}:definedName{n}", [Piece(x)], change=bare)
        elif _COMMENTS.match(name):
            for n, x in enumerate(_below(part, "text")):
                self._rich(f"{name}:comment{n}", x)
        elif _THREADS.match(name):
            for n, x in enumerate(_below(part, "text")):
                self._add(f"{name}:thread{n}", [Piece(x)])
        elif _TABLE.match(name):
            self._attributes(name, _below(part, "tableColumn"), ("name",))

    def _paragraphs(self, name: str, part: minidom.Document) -> None:
        kinds = self._table_kinds(part)
        for n, p in enumerate(x for x in _below(part, "p") if _word(x)):
            streams: dict[str, list[Piece]] = {"text": [], "deleted": [], "field": []}
            for x in _below(p, "t", "delText", "instrText", "tab", "br", "cr", past=("p",)):
                if not _word(x):
                    continue
                if x.localName in ("tab", "br", "cr"):
                    if x.parentNode.localName == "r":  # a tab elsewhere is a tab stop
                        streams["text"].append(Piece(x, sign="\t" if x.localName == "tab" else "\n"))
                else:
                    streams[{"t": "text", "delText": "deleted", "instrText": "field"}[x.localName]].append(Piece(x))
            for stream, pieces in streams.items():
                self._add(f"{name}:p{n}:{stream}", pieces, column_kind=kinds.get(id(p)) if stream == "text" else None)
        self._attributes(name, _below(part, "docPr"), ("descr", "title"))

    @staticmethod
    def _table_kinds(part: minidom.Document) -> dict[int, str]:
        """Kinds of the paragraphs below a known title, by the grid column where their cell begins."""
        out: dict[int, str] = {}

        def cells(row: minidom.Element) -> Iterator[tuple[int, minidom.Element]]:
            at = 0
            for cell in _children(row, "tc"):
                yield at, cell
                spans = [x.getAttributeNode("w:val") or next(iter(x.attributes.values()), None) for pr in _children(cell, "tcPr") for x in _children(pr, "gridSpan")]
                at += _number(spans[0].value, 1) if spans and spans[0] else 1

        for table in _below(part, "tbl"):
            rows = _children(table, "tr")
            if len(rows) < 2:
                continue
            kinds = {at: title_kind("".join(Piece(t).get() for t in _below(cell, "t"))) for at, cell in cells(rows[0])}
            for row in rows[1:]:
                for at, cell in cells(row):
                    if kinds.get(at):
                        for p in _below(cell, "p"):
                            out.setdefault(id(p), kinds[at])
        return out

    def _rich(self, name: str, node: minidom.Element) -> Segment | None:
        """A string of runs; its reading aid is a segment too and goes once the string is edited."""
        aids = _children(node, "rPh")

        def drop() -> None:
            for x in aids:
                if x.parentNode is node:
                    node.removeChild(x)

        made = self._add(name, [Piece(x) for x in _below(node, "t", past=("rPh",))], after=drop)
        self._add(f"{name}:ph", [Piece(t) for x in aids for t in _below(x, "t")])
        return made

    def _sheets(self) -> None:
        named = {s.name: s for s in self.segments}
        titles, digits, first = self._sheet_names(), 0, []
        for name, part in self.parts.items():
            if not _SHEET.match(name):
                continue
            at, rows = 0, {}
            for n, row in enumerate(_below(part, "row")):
                at, column = _number(row.getAttribute("r"), at + 1), 0
                for m, cell in enumerate(_children(row, "c")):
                    letters = re.match("[A-Z]{1,3}", cell.getAttribute("r"))
                    column = sum((ord(c) - 64) * 26**i for i, c in enumerate(letters[0][::-1])) if letters else column + 1
                    kind, where = cell.getAttribute("t"), f"{name}:row{n}:cell{m}"
                    made = None
                    for x in _children(cell, "is"):
                        made = self._rich(where, x)
                    for x in _children(cell, "f"):
                        self._add(f"{where}:f", [Piece(x)], change=bare)
                    for x in _children(cell, "v"):
                        if kind == "str":
                            self._add(f"{where}:v", [Piece(x)])
                        elif kind == "s":
                            made = named.get(f"xl/sharedStrings.xml:si{Piece(x).get().strip()}")
                        elif kind in ("", "n") and re.fullmatch(r"\d{9,12}", Piece(x).get()):
                            digits += 1
                            first.append(f"{titles.get(name, name)}!{cell.getAttribute('r')}") if len(first) < 3 else None
                    if made:
                        rows.setdefault(at, {})[column] = made
            self._column_kinds(rows)
            self._attributes(name, _below(part, "hyperlink"), ("display", "tooltip"))
            self._attributes(name, _below(part, "hyperlink"), ("location",), bare)
            self._attributes(name, _below(part, "dataValidation"), ("promptTitle", "prompt", "errorTitle", "error"))
            for n, x in enumerate(_below(part, *HEADERS)):
                self._add(f"{name}:{x.localName}{n}", [Piece(x)])
            for n, x in enumerate(_below(part, "formula1", "formula2", "formula")):
                self._add(f"{name}:{x.localName}:{n}", [Piece(x)], change=bare)
        if digits:
            self.notes.append(("numeric identifiers", digits, ", ".join(first)))

    @staticmethod
    def _column_kinds(rows: dict[int, dict[int, Segment]]) -> None:
        """The first row with a known title, among the first that hold strings, names the columns below it."""
        for top in sorted(rows)[:_HEADER_ROWS]:
            kinds = {column: kind for column, s in rows[top].items() if (kind := title_kind(s.text))}
            if kinds:
                for at in sorted(rows):
                    for column, s in rows[at].items():
                        if at > top and column in kinds and s.column_kind is None and s not in rows[top].values():
                            s.column_kind = kinds[column]
                return

    def _sheet_names(self) -> dict[str, str]:
        rels = self.parts.get("xl/_rels/workbook.xml.rels")
        targets = {x.getAttribute("Id"): x.getAttribute("Target") for x in _below(rels, "Relationship")} if rels else {}
        out = {}
        for x in _below(self.parts["xl/workbook.xml"], "sheet"):
            target = next((targets.get(a.value) for a in x.attributes.values() if a.localName == "id"), None)
            if target:
                out[target.lstrip("/") if target.startswith("/") else f"xl/{target}"] = x.getAttribute("name")
        return out

    def _scrub(self) -> None:
        """Empties who wrote, changed or commented; the preview picture's link goes with it."""
        for name, part in self.parts.items():
            for x in _below(part):
                if name.startswith("docProps/") and x.localName in EMPTIED or _COMMENTS.match(name) and x.localName == "author":
                    Piece(x).put("")
                for a in list(x.attributes.values()):
                    if _word(x) and a.localName in ("author", "initials") or x.localName == "fileSharing" and a.localName == "userName" or _PEOPLE.match(name) and a.localName in ("author", "displayName", "userId"):
                        x.setAttribute(a.name, "")
                if name == "_rels/.rels" and x.localName == "Relationship" and x.getAttribute("Type").endswith("/thumbnail"):
                    x.parentNode.removeChild(x)

    def written(self, edits: dict[str, list[tuple[int, int, str]]]) -> bytes:
        """The package with edited segments; parts that are not read are copied byte for byte."""
        named = {s.name: s for s in self.segments}
        for name in sorted(edits, key=lambda n: not n.endswith(":ph")):  # before a string drops its reading aid
            named[name].edit(edits[name])
        self._scrub()
        out = io.BytesIO()
        with zipfile.ZipFile(io.BytesIO(self.content)) as old, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
            for info in old.infolist():
                if info.filename.startswith("docProps/thumbnail."):
                    continue
                part = self.parts.get(info.filename)
                new.writestr(info, part.toxml(encoding="UTF-8", standalone=True) if part else old.read(info), zipfile.ZIP_DEFLATED)
        return out.getvalue()
