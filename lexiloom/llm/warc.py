"""WARC responses, and the metadata and plain-text records derived from them."""

from __future__ import annotations

import base64
import codecs
import hashlib
import html as entities
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.session import text_batches

DATE = "2024-01-01T00:00:00Z"
RECORDS = "page_id long, record binary, error string"
DERIVED = "page_id long, record_type string, record_id string, refers_to string, target_uri string, warc_date string, source_headers map<string,string>, source_digest string, block_digest string, content string, record binary, error string"
LARGEST = 1 << 28
HEADER = 1 << 20
STEP, PIECE = 1 << 14, 1 << 18
GZIP, BROKEN = b"\x1f\x8b\x08", b"broken"
FILE_PAGES = 200
BATCH = 4 << 20
PAGE_ID = "X-Page-ID"

# HTML elements whose content is no text, and those that end a line.
HIDDEN = ["script", "style", "noscript", "template", "textarea"]
BLOCKS = "address article aside blockquote body br dd div dl dt figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol option p pre section table td th title tr ul".split()
# Which attribute of which element is a link.
LINKS = {"a": "href", "area": "href", "link": "href", "img": "src", "script": "src", "iframe": "src", "form": "action", "source": "src"}
# Media types that are read as HTML, and what else has text.
HTML_TYPES = ["", "text/html", "application/xhtml+xml", "application/xml", "text/xml"]

OPENS = re.compile(r"<(?:(!--)|([!?])|(/?)([a-z][^\s/>]*+))", re.I)
ATTRIBUTE = re.compile(r"[\s/]*+(?:([^\s/>=][^\s/>=]*+|=)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?+)?+")
#: Addresses that need no more than to be put behind a site's.
ROOT, PLAIN = re.compile(r"https?://[^/?#\s]++"), re.compile(r"/(?!/)[\w/=&%+~-]*+(?:\?[\w/=&%+~-]++)?+")
CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.I)
CLOSES = {x: re.compile(rf"</{x}(?=[\s/>])", re.I) for x in HIDDEN}
_BLOCKS = frozenset(BLOCKS)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*of: object) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(repr(of).encode('utf-8', 'replace')).digest()[:16], version=5)}>"


def serialize(headers: dict[str, str], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in headers.items())
    return f"WARC/1.0\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def fields(lines: list[str]) -> list[tuple[str, str]]:
    """(name, value) of header lines; a line that begins with a blank goes on."""
    out: list[tuple[str, str]] = []
    for line in lines:
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
        else:
            name, _, value = line.partition(":")
            out.append((name.strip(), value.strip()))
    return out


def unpacked(data: bytes) -> Iterator[bytes]:
    """A WARC file's bytes in pieces of up to PIECE, its gzip members (one for
    each record or more) undone as they are met; no byte is copied more often
    than its step holds. ``BROKEN`` stands where a member can't be read to its
    end; reading goes on at the next that begins."""
    if not data.startswith(GZIP):
        yield from (data[i : i + PIECE] for i in range(0, len(data), PIECE))
        return
    at = 0
    while at >= 0 and at < len(data):
        member, start = zlib.decompressobj(31), at
        try:
            while not member.eof and (at < len(data) or member.unconsumed_tail):
                step = member.unconsumed_tail or data[at : at + STEP]
                at += 0 if member.unconsumed_tail else len(step)
                yield member.decompress(step, PIECE)
            if not member.eof:
                yield BROKEN
                return
            at -= len(member.unused_data)
        except zlib.error:
            yield BROKEN
            at = start + 1
        while at < len(data) and data[at : at + 1] == b"\0":  # padding
            at += 1
        if not data.startswith(GZIP, at) and at < len(data):
            at = data.find(GZIP, at)


class Source:
    """Bytes of a file that are read as they are asked for, and no longer kept once dropped."""

    def __init__(self, data: bytes):
        self.pieces, self.kept, self.ended, self.broken = unpacked(data), bytearray(), False, False

    def more(self) -> bool:
        """Reads on; False at the end. After a broken member a line's end stands in for what is lost."""
        piece = next(self.pieces, None)
        if piece is None:
            self.ended = True
            return False
        if piece is BROKEN:
            self.broken = True
            piece = b"\r\n\r\n"
        self.kept += piece
        return True

    def reach(self, n: int) -> bool:
        while len(self.kept) < n and self.more():
            pass
        return len(self.kept) >= n

    def find(self, mark: bytes, start: int, most: int) -> int:
        """Where a mark begins, -1 if not within ``most`` bytes."""
        while (at := self.kept.find(mark, start)) < 0 and len(self.kept) < most:
            start = max(start, len(self.kept) - len(mark) + 1)
            if not self.more():
                return -1
        return at

    def take(self, n: int) -> bytes:
        out = bytes(self.kept[:n])
        del self.kept[:n]
        return out


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, block) of one record; ValueError where it is none."""
    end = record.find(b"\r\n\r\n")
    if end < 0 or not record.startswith(b"WARC/"):
        raise ValueError("no WARC record")
    headers = dict(fields(record[:end].decode("utf-8", "replace").split("\r\n")[1:]))
    length = headers.get("Content-Length", "")
    if not length.isdigit():
        raise ValueError("no Content-Length")
    block = record[end + 4 : end + 4 + int(length)]
    if len(block) < int(length):
        raise ValueError("block shorter than Content-Length")
    if "WARC-Record-ID" not in headers:
        raise ValueError("no WARC-Record-ID")
    return headers, block


def split_records(data: bytes, most: int = LARGEST) -> Iterator[tuple[bytes, str | None]]:
    """(record, error) of a WARC file in order, read once. Where a record is
    broken, its error is told with what there is of it (``most`` bytes at the
    most) and reading goes on at the next line that begins one. A record of more
    than ``most`` bytes is passed over and told; no more than one is held."""
    source = Source(data)
    while source.reach(1):
        error, end = None, source.find(b"\r\n\r\n", 0, HEADER)
        length = re.search(rb"(?im)^content-length:[ \t]*(\d{1,18})[ \t]*\r?$", bytes(source.kept[:end])) if end >= 0 and source.kept.startswith(b"WARC/") else None
        if length:
            size = end + 4 + int(length[1])
            if size > most:
                head, left = source.take(end + 4), size - end - 4
                while left and source.reach(1):
                    left -= len(source.take(min(left, PIECE)))
                source.reach(4)
                source.take(4 if source.kept.startswith(b"\r\n\r\n") else 0)
                yield head, f"record over {most} bytes"
                continue
            if source.reach(size):
                source.reach(size + 9)
                after = size + 4 if source.kept[size : size + 4] == b"\r\n\r\n" else size
                if after >= len(source.kept) or source.kept.startswith(b"WARC/", after) or (source.broken and after > size):
                    yield source.take(size), None
                    source.take(after - size)
                    continue
            error = "block does not end where Content-Length says"
        begun, going_on = b"", source.find(b"\r\n\r\nWARC/", int(source.kept.startswith(b"WARC/")), most)
        while going_on < 0 and not source.ended:
            begun = begun or bytes(source.kept[:most])
            source.take(max(0, len(source.kept) - 8))
            going_on = source.find(b"\r\n\r\nWARC/", 0, most)
        rest = source.take(going_on + 4 if going_on >= 0 else len(source.kept))
        error, source.broken = "gzip member cut short or broken" if source.broken else error or "no WARC record", False
        yield begun or rest, error


def response_record(page_id: object, url: str, page: str) -> bytes:
    payload = page.encode("utf-8", "replace")
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    headers = {
        "WARC-Type": "response",
        "WARC-Record-ID": record_id("response", page_id, url, digest(payload)),
        "WARC-Date": DATE,
        "WARC-Target-URI": re.sub(r"[\x00-\x20]+", "%20", url),
        "WARC-Payload-Digest": digest(payload),
        "WARC-Block-Digest": digest(block),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if page_id is not None:
        headers[PAGE_ID] = str(page_id)
    return serialize(headers, block)


def read_html(page: str, url: str) -> tuple[str, str, list[dict[str, str]]]:
    """(title, plain text, links) of a page, in one pass that never goes back.
    A ``<`` that opens nothing is text; a comment, tag or script that isn't
    closed hides the rest, as it does in browsers."""
    parts, links, title, in_title, at = [], [], [], False, 0
    root = ROOT.match(url)
    while m := OPENS.search(page, at):
        if m.start() > at:
            (title if in_title else parts).append(page[at : m.start()])
        if m[1] or m[2]:
            close = page.find("-->" if m[1] else ">", m.end())
            at = len(page) if close < 0 else close + (3 if m[1] else 1)
            continue
        name, found, at = m[4].lower(), {}, m.end()
        while (a := ATTRIBUTE.match(page, at)).end() > at:
            at = a.end()
            if a[1]:
                found.setdefault(a[1].lower(), a[2] or a[3] or a[4] or "")
        at += 1  # the closing mark, or the text's end
        if name == "title":
            in_title = not m[3]
        elif name in _BLOCKS:
            parts.append("\n")
        if not m[3]:
            if (target := found.get(LINKS.get(name, ""))) and at <= len(page):
                target = entities.unescape(target)
                if root and PLAIN.fullmatch(target):
                    target = root[0] + target
                else:
                    try:
                        target = urljoin(url, target)
                    except ValueError:
                        pass
                links.append({"path": f"{name.upper()}@/{LINKS[name]}", "url": target})
            if name in CLOSES:
                close = CLOSES[name].search(page, at)
                at = close.start() if close else len(page)
    (title if in_title else parts).append(page[at:])
    lines = (" ".join(x.split()) for x in entities.unescape("".join(parts)).split("\n"))
    return " ".join(entities.unescape("".join(title)).split()), "\n".join(x for x in lines if x), links


def dechunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at : end if end >= 0 else len(body)].split(b";")[0].strip()
        if not re.fullmatch(rb"[0-9a-fA-F]{1,15}", size):
            raise ValueError("broken chunk")
        n = int(size, 16)
        if not n:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        if end < 0 or len(out[-1]) < n:
            raise ValueError("broken chunk")
        at = end + 2 + n + 2


def decoded(body: bytes, coding: str) -> bytes:
    """The body without its content coding; ValueError where that can't be undone."""
    for name in reversed([x.strip().lower() for x in coding.split(",") if x.strip()]):
        if name in ("identity", "utf-8"):
            continue
        if name not in ("gzip", "x-gzip", "deflate"):
            raise ValueError(f"content coding {name}")
        try:
            member = zlib.decompressobj(15 + 32 if name != "deflate" or body[:1] == b"\x78" else -15)
            body = member.decompress(body, LARGEST)
        except zlib.error as e:
            raise ValueError(f"{name}: {e}") from None
        if not member.eof:
            raise ValueError(f"body over {LARGEST} bytes" if member.unconsumed_tail else f"{name}: cut short")
    return body


def text_of(body: bytes, content_type: str) -> str:
    """The body in the character set that its type or its first kilobyte names, else UTF-8."""
    named = CHARSET.search(content_type) or CHARSET.search(body[:1024].decode("latin-1"))
    try:
        name = codecs.lookup(named[1]).name if named else "utf-8"
        return body.decode(name, "replace")
    except (LookupError, ValueError):
        return body.decode("utf-8", "replace")


def http_response(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """(status line, headers as they stand, payload) of an HTTP response."""
    head, separator, payload = block.partition(b"\r\n\r\n")
    if not separator or not head.startswith(b"HTTP/"):
        raise ValueError("no HTTP response")
    status, *lines = head.decode("utf-8", "replace").split("\r\n")
    return status, fields(lines), payload


def derivatives(headers: dict[str, str], block: bytes) -> list[tuple[dict[str, str], str, bytes]]:
    """(headers, content, record) of a response's metadata record and, if it has
    text, its conversion; ValueError where its HTTP message is broken."""
    status, http, payload = http_response(block)
    first: dict[str, str] = {}
    for k, v in http:
        first.setdefault(k.lower(), v)
    body = dechunked(payload) if first.get("transfer-encoding", "").lower().endswith("chunked") else payload
    body = decoded(body, first.get("content-encoding", ""))
    content_type = first.get("content-type", "")
    kind = content_type.split(";")[0].strip().lower()
    source, url = headers["WARC-Record-ID"], headers.get("WARC-Target-URI", "")
    payload_digest = headers.get("WARC-Payload-Digest") or digest(payload)
    repeated: dict[str, str | list[str]] = {}
    for k, v in http:
        have = repeated.get(k)
        repeated[k] = v if have is None else [*(have if isinstance(have, list) else [have]), v]
    response: dict[str, object] = {"Response-Message": status, "Headers": repeated, "Entity-Length": len(payload), "Entity-Digest": digest(payload)}
    text = None
    if kind in HTML_TYPES:
        title, text, links = read_html(text_of(body, content_type), url)
        response["HTML-Metadata"] = {"Head": {"Title": title}, "Links": links}
    elif kind.startswith("text/") or kind == "application/json":
        text = text_of(body, content_type)
    envelope = {"WARC-Header-Metadata": headers, "Payload-Metadata": {"Actual-Content-Type": headers.get("Content-Type"), "HTTP-Response-Metadata": response}}
    out = []
    for record_type, made, content in (("metadata", "application/json", json.dumps({"Envelope": envelope}, ensure_ascii=False)), ("conversion", "text/plain; charset=utf-8", text)):
        if content is None:
            continue
        own = content.encode("utf-8", "replace")
        head = {
            "WARC-Type": record_type,
            "WARC-Record-ID": record_id(record_type, source),
            "WARC-Refers-To": source,
            "WARC-Date": headers.get("WARC-Date", DATE),
            "WARC-Target-URI": url,
            "WARC-Source-Payload-Digest": payload_digest,
            "WARC-Source-Block-Digest": headers.get("WARC-Block-Digest") or digest(block),
            "WARC-Block-Digest": digest(own),
            "Content-Type": made,
            "Content-Length": str(len(own)),
        }
        out.append((head, content, serialize(head, own)))
    return out


def _derived(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in DERIVED.split(", ")]
    for batch in batches:
        for at in range(0, len(batch), 500):
            rows = []
            part = batch.iloc[at : at + 500]
            for page_id, record, error in zip(part["page_id"], part["record"], part["error"], strict=True):
                headers: dict[str, str] = {}
                try:
                    if error:
                        raise ValueError(error)
                    headers, block = parse_record(bytes(record or b""))
                    if headers.get("WARC-Type") != "response":
                        continue
                    if pd.isna(page_id) and re.fullmatch(r"-?\d{1,18}", headers.get(PAGE_ID, "")):
                        page_id = int(headers[PAGE_ID])  # noqa: PLW2901
                    made = derivatives(headers, block)
                except ValueError as e:
                    rows.append((page_id, "error", None, headers.get("WARC-Record-ID"), headers.get("WARC-Target-URI"), headers.get("WARC-Date"), headers, headers.get("WARC-Payload-Digest"), None, None, None, str(e)))
                    continue
                for head, content, made_record in made:
                    rows.append((page_id, head["WARC-Type"], head["WARC-Record-ID"], head["WARC-Refers-To"], head["WARC-Target-URI"], head["WARC-Date"], headers, head["WARC-Source-Payload-Digest"], head["WARC-Block-Digest"], content, made_record, None))
            yield pd.DataFrame(rows, columns=names).astype({"page_id": "Int64"})


def _responses(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for at in range(0, len(batch), 500):
            part = batch.iloc[at : at + 500]
            made = [response_record(None if pd.isna(i) else int(i), u or "", h or "") for i, u, h in zip(part["page_id"], part["url"], part["html"], strict=True)]
            yield pd.DataFrame({"page_id": part["page_id"].astype("Int64").to_numpy(), "record": made, "error": [None] * len(made)})


def responses_of_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, html) -> page_id and one response record each, as it
    stands in a WARC file (with the page's id in a header of its own), and no
    error. A null url or page is empty; ids follow
    from id, url and payload, so repeated rows have one record id."""
    text_batches(pages.sparkSession, 500)
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return base.mapInPandas(_responses, RECORDS)


def warc_files(records: DataFrame, per_file: int = FILE_PAGES) -> DataFrame:
    """(record) -> content: gzip WARC files of up to ``per_file`` records, each a
    member of its own, in the rows' order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), per_file):
                yield pd.DataFrame({"content": pd.Series([b"".join(map(_member, batch["record"].iloc[at : at + per_file]))], dtype=object)})

    return records.select("record").where("record is not null").mapInPandas(run, "content binary")


def _member(record: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(bytes(record)) + packer.flush()


def read_warc_files(files: DataFrame) -> DataFrame:
    """Rows of Spark's binaryFile source (content), plain or gzip -> (page_id
    null, record, error), one row for each record; a broken one, or one whose
    gzip member is cut short, has its error, and those after it are read all the
    same. A file is unpacked as it is read, in one pass: besides the file itself
    a task holds one record of up to LARGEST bytes (a longer one is an error row
    with its header), and a few MB of rows. binaryFile itself takes files of up
    to 2 GB; Spark hands them over by 64 MB or one file at a time."""

    def frame(rows: list[tuple[bytes, str | None]]) -> pd.DataFrame:
        return pd.DataFrame({"page_id": pd.array([None] * len(rows), "Int64"), "record": pd.Series([r for r, _ in rows], dtype=object), "error": pd.Series([e for _, e in rows], dtype=object)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                rows, held = [], 0
                for record, error in split_records(bytes(content or b"")):
                    rows.append((record, error))
                    held += len(record)
                    if held > BATCH:
                        yield frame(rows)
                        rows, held = [], 0
                if rows:
                    yield frame(rows)

    return files.select("content").mapInPandas(run, RECORDS)


def build_derivatives(records: DataFrame) -> DataFrame:
    """Records (page_id, record, error) -> two rows for each response, metadata
    and conversion: own and source identifiers, source headers and digests,
    content, and the whole record as it stands in a WARC file.

    The metadata record is JSON: the response's WARC and HTTP headers (repeated
    ones as a list), title and links made absolute; the conversion record is the
    page's text, a line for each block, without scripts, styles and comments.
    Both refer to the response and carry its date, address and digests. Chunks
    and content codings (gzip, deflate; LARGEST bytes at most) are undone, the
    character set is that of the type, else of the page, else UTF-8. Plain text
    and JSON are their own conversion; other types have metadata only.

    What isn't a response is left out. A broken record or message gives one row
    of type ``error`` that tells why. An empty page gives an empty text and no
    links; repeated rows give repeated records; other columns are ignored; an
    empty table gives an empty table; pages are read in one pass, however long
    or broken. Rows are independent: no shuffle, some pages in memory at a time.
    """
    text_batches(records.sparkSession, 500)
    return records.select("page_id", "record", "error").mapInPandas(_derived, DERIVED)
