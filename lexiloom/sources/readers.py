"""File readers: Spark's binaryFile rows in, text out.

Each format has a small parser of one file's bytes; ``read_texts`` runs them
where Spark has put the files.
"""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Encodings in the order they are tried, and the HTML elements that are no content.
ENCODINGS = ["utf-8", "utf-16", "gbk", "gb2312", "latin-1"]
DROPPED = ["nav", "footer", "script", "style", "header", "aside"]
MAIN = ["article", "main", "body"]
#: Classes of what is no content either, and of the element that holds it.
SIDE = re.compile(r"sidebar|sphinxsidebar|related|navigation|navbar|breadcrumb")
CENTRE = re.compile(r"document|body|content|main")
# What is put before a recognised text, a description and a slide's notes.
OCR_TITLE, SEEN_TITLE, NOTES_TITLE = "[OCR 文字内容]", "[图片内容描述]", "[备注]"
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]


def decode(data: bytes) -> str:
    """Text in the first encoding that fits; UTF-16 only with its mark, as most
    bytes of an even number would fit it."""
    for name in ENCODINGS:
        if name == "utf-16" and data[:2] not in (b"\xff\xfe", b"\xfe\xff"):
            continue
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            continue
    return data.decode("utf-8", "ignore")


class _Page(HTMLParser):
    """Collects text by the outermost main element it is in; headings keep
    their level, code is fenced."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.tags: list[str] = []
        self.found: dict[str, list[str]] = {"": []} | {x: [] for x in MAIN}

    def put(self, text: str) -> None:
        for where in ["", *(x for x in MAIN if x in self.open)]:
            self.found[where].append(text)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in VOID:
            kinds = dict(attrs).get("class") or ""
            role = "main" if ("role", "main") in attrs or (tag == "div" and CENTRE.search(kinds)) else tag
            self.open.append("aside" if SIDE.search(kinds) else role)
            self.tags.append(tag)
        if re.fullmatch("h[1-6]", tag):
            self.put("\n" + "#" * int(tag[1]) + " ")
        elif tag == "pre":
            self.put("\n```\n")
        elif tag in ("p", "div", "li", "br", "tr", "section"):
            self.put("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in self.tags:
            while self.tags.pop() != tag:
                self.open.pop()
            self.open.pop()
        if tag == "pre":
            self.put("\n```\n")
        elif re.fullmatch("h[1-6]|p|div|li|tr", tag):
            self.put("\n")

    def handle_data(self, data: str) -> None:
        if not any(x in DROPPED for x in self.open):
            self.put(data if "pre" in self.open else re.sub(r"\s+", " ", data))


class _Markdown(_Page):
    """The same with lists, links and tables as Markdown has them."""

    def __init__(self) -> None:
        super().__init__()
        self.links: list[str] = []
        self.cells: int | None = None
        self.headed = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        super().handle_starttag(tag, attrs)
        if any(x in DROPPED for x in self.open):
            return
        if tag == "li":
            self.put("1. " if [x for x in self.tags if x in ("ul", "ol")][-1:] == ["ol"] else "- ")
        elif tag == "a":
            self.links.append(dict(attrs).get("href") or "")
            self.put("[")
        elif tag == "table":
            self.headed = False
        elif tag == "tr":
            self.cells = 0
            self.put("|")
        elif tag in ("td", "th") and self.cells is not None:
            self.cells += 1
            self.put(" ")

    def handle_endtag(self, tag: str) -> None:
        if not any(x in DROPPED for x in self.open):
            if tag == "a" and self.links:
                self.put(f"]({self.links.pop()})")
            elif tag in ("td", "th"):
                self.put(" |")
            elif tag == "tr" and self.cells:
                self.put("" if self.headed else "\n|" + " --- |" * self.cells)
                self.headed, self.cells = True, None
        super().handle_endtag(tag)


def html_markdown(page: str) -> str:
    """A page's content as Markdown: headings, lists, links, code and tables;
    items and rows stand on lines that follow one another."""
    return re.sub(r"(?m)^((?:\||- |1\. ).*)\n+(?=\||- |1\. )", r"\1\n", _text_of(_Markdown(), page))


def html_text(page: str) -> str:
    return _text_of(_Page(), page)


def _text_of(parser: _Page, page: str) -> str:
    parser.feed(page)
    parser.close()
    parts = next((parser.found[x] for x in MAIN if "".join(parser.found[x]).strip()), parser.found[""])
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]*\n[ \t]*", "\n", "".join(parts))).strip()


def markdown_table(rows: list[list[str]]) -> str:
    """A table of the first row's width: short rows are filled, long ones cut."""
    if not rows:
        return ""
    width = len(rows[0])
    clean = [[re.sub(r"\s+", " ", str(c if c is not None else "")).replace("|", "\\|").strip() for c in [*r, *[""] * width][:width]] for r in rows]
    lines = ["| " + " | ".join(r) + " |" for r in clean]
    return "\n".join([lines[0], "| " + " | ".join(["---"] * width) + " |", *lines[1:]])


def csv_text(data: bytes) -> str:
    return markdown_table([r for r in csv.reader(io.StringIO(decode(data))) if any(c.strip() for c in r)])


def flatten_json(value: object, path: str = "") -> Iterator[str]:
    """A line ``a.b[0]: v`` for each leaf."""
    if isinstance(value, dict) and value:
        for k, v in value.items():
            yield from flatten_json(v, f"{path}.{k}" if path else str(k))
    elif isinstance(value, list) and value:
        for i, v in enumerate(value):
            yield from flatten_json(v, f"{path}[{i}]")
    else:
        yield f"{path}: {value}"


def json_text(data: bytes) -> str:
    return "\n".join(flatten_json(json.loads(decode(data))))


def _xml(archive: zipfile.ZipFile, name: str) -> ElementTree.Element:
    return ElementTree.fromstring(archive.read(name))


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def docx_text(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        paragraphs = ("".join(t.text or "" for t in p.iter() if _local(t.tag) == "t") for p in _xml(archive, "word/document.xml").iter() if _local(p.tag) == "p")
        return "\n".join(p for p in paragraphs if p.strip())


def pptx_text(data: bytes) -> str:
    """Every slide's paragraphs, its tables' rows with bars, and its notes."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        names = set(archive.namelist())
        slides = sorted((n for n in names if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))

        def said(node: ElementTree.Element) -> str:
            return "".join(t.text or "" for t in node.iter() if _local(t.tag) == "t")

        def paragraphs(node: ElementTree.Element) -> Iterator[str]:
            for child in node:
                if _local(child.tag) == "p":
                    yield said(child)
                elif _local(child.tag) == "tr":
                    yield " | ".join(" ".join(x for x in paragraphs(c) if x.strip()).strip() for c in child if _local(c.tag) == "tc")
                else:
                    yield from paragraphs(child)

        out = []
        for i, name in enumerate(slides, 1):
            lines = [x for x in paragraphs(_xml(archive, name)) if x.strip()]
            notes = name.replace("slides/slide", "notesSlides/notesSlide")
            if notes in names and (note := "\n".join(x for x in paragraphs(_xml(archive, notes)) if x.strip())):
                lines.append(f"{NOTES_TITLE} {note}")
            out.append("\n".join([f"## Slide {i}", *lines]))
        return "\n\n".join(out)


def xlsx_text(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        names = archive.namelist()
        shared = ["".join(t.text or "" for t in s.iter() if _local(t.tag) == "t") for s in _xml(archive, "xl/sharedStrings.xml") if _local(s.tag) == "si"] if "xl/sharedStrings.xml" in names else []
        titles = [s.attrib["name"] for s in _xml(archive, "xl/workbook.xml").iter() if _local(s.tag) == "sheet"]
        sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
        out = []
        for title, name in zip(titles, sheets, strict=False):
            rows = []
            for row in (r for r in _xml(archive, name).iter() if _local(r.tag) == "row"):
                cells: dict[int, str] = {}
                for c in (c for c in row if _local(c.tag) == "c"):
                    at = 0
                    for letter in re.match("[A-Z]*", c.attrib.get("r", ""))[0]:
                        at = at * 26 + ord(letter) - 64
                    text = "".join(t.text or "" for t in c.iter() if _local(t.tag) in ("v", "t"))
                    cells[at or len(cells) + 1] = shared[int(text)] if c.attrib.get("t") == "s" and text else text
                if any(v.strip() for v in cells.values()):
                    rows.append([cells.get(i, "") for i in range(1, max(cells) + 1)])
            out.append(f"## {title}\n\n{markdown_table(rows)}")
        return "\n\n".join(out)


READERS: dict[str, Callable[[bytes], str]] = {
    "txt": decode,
    "md": decode,
    "markdown": decode,
    "html": lambda b: html_text(decode(b)),
    "htm": lambda b: html_text(decode(b)),
    "csv": csv_text,
    "json": json_text,
    "docx": docx_text,
    "pptx": pptx_text,
    "xlsx": xlsx_text,
}


def read_texts(files: DataFrame, readers: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """Rows of the binaryFile source -> path, extension, digest, text, error.
    ``readers`` adds or replaces formats (PDF, images and audio need models
    that are passed in here); an unknown extension or a broken file is an error
    in its row."""
    known = READERS | (readers or {})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, extension, content in zip(batch["path"], batch["extension"], batch["content"], strict=True):
                text = error = None
                try:
                    text = known[extension](bytes(content))
                except KeyError:
                    error = f"unsupported format: {extension}"
                except (ValueError, zipfile.BadZipFile, ElementTree.ParseError) as e:
                    error = f"{type(e).__name__}: {e}"[:200]
                rows.append((path, extension, text, error))
            yield pd.DataFrame(rows, columns=["path", "extension", "text", "error"])

    named = files.select("path", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("extension"), "content")
    return named.mapInPandas(run, "path string, extension string, text string, error string")


@dataclass(frozen=True)
class PdfPage:
    """What a PDF library tells of a page: its text, itself and its figures as images, its tables' rows."""

    text: str
    image: bytes = b""
    figures: tuple[bytes, ...] = ()
    tables: tuple[list[list[str]], ...] = ()


def is_scanned(texts: list[str], least: int = 50) -> bool:
    """Whether pages have under ``least`` characters on average."""
    return not texts or sum(len(t.strip()) for t in texts) / len(texts) < least


def image_reader(recognize: Callable[[bytes], str] | None = None, describe: Callable[[bytes], str] | None = None) -> Callable[[bytes], str]:
    """A reader of images by a text recogniser, a describer, or both."""

    def read(data: bytes) -> str:
        parts = [(title, f(data).strip()) for title, f in ((OCR_TITLE, recognize), (SEEN_TITLE, describe)) if f]
        return "\n\n".join(f"{title}\n{text}" for title, text in parts if text)

    return read


def pdf_reader(pages: Callable[[bytes], list[PdfPage]], recognize: Callable[[bytes], str] | None = None, describe: Callable[[bytes], str] | None = None, least: int = 50) -> Callable[[bytes], str]:
    """A reader of PDF by a library's pages: text, recognised where a page has
    under ``least`` characters, its figures' descriptions and its tables."""

    def read(data: bytes) -> str:
        out = []
        for page in pages(data):
            scanned = len(page.text.strip()) < least and recognize is not None
            parts = [recognize(page.image) if scanned else page.text, *(describe(x) for x in page.figures if describe), *(markdown_table(t) for t in page.tables)]
            out.append("\n\n".join(x.strip() for x in parts if x and x.strip()))
        return "\n\n".join(x for x in out if x)

    return read


def directory_state(spark: SparkSession, path: str) -> DataFrame:
    """(filename, hash) of all files under a folder, for change detection."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"), F.sha2("content", 256).alias("hash"))


def image_address(content: Column) -> Column:
    """A content-addressed image name: twelve digits of its MD5 and an
    extension by its first bytes."""
    head = F.hex(F.substring(content, 1, 4))
    kind = F.when(head.startswith("89504E47"), "png").when(head.startswith("FFD8FF"), "jpg").when(head.startswith("47494638"), "gif").when(head.startswith("52494646"), "webp").otherwise("png")
    return F.concat(F.left(F.md5(content), F.lit(12)), F.lit("."), kind)


def links(html: Column, base: Column, most: int = 20) -> Column:
    """The first distinct links of a page to its own host, relative ones made
    absolute, without fragments and binary files."""
    root, folder = F.regexp_extract(base, r"^([a-z]+://[^/?#]+)", 1), F.regexp_extract(base, r"^([a-z]+://[^?#]*/)", 1)

    def absolute(x: Column) -> Column:
        return F.when(x.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), x).when(x.startswith("//"), F.concat(F.regexp_extract(base, "^([a-z]+:)", 1), x)).when(x.startswith("/"), F.concat(root, x)).otherwise(F.concat(folder, x))

    found = F.transform(F.regexp_extract_all(html, F.lit(r"""<a\s[^>]*href=["']([^"'#]+)"""), F.lit(1)), absolute)
    host = r"^[a-z]+://([^/?#:]+)"
    own = F.filter(found, lambda x: (F.regexp_extract(x, host, 1) == F.regexp_extract(base, host, 1)) & ~x.rlike(r"(?i)\.(png|jpe?g|gif|svg|pdf|zip|gz|mp4)$"))
    return F.slice(F.array_distinct(own), 1, most)
