"""Operator 7: WARC derivatives: metadata and plain-text conversion records that refer to their responses.

Records are rows (record_id, warc_type, refers_to, target_uri, warc_date, content_type, payload_digest, block_digest,
content_length, headers, content); to_bytes() and parse() turn them into WARC/1.1 files and back.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexmat.llm import common

#: Date of records made from pages that carry none.
DATE = "1970-01-01T00:00:00Z"
RECORD = "record_id string, warc_type string, refers_to string, target_uri string, warc_date string, content_type string, payload_digest string, block_digest string, content_length long, headers map<string,string>, content binary"
_NAMES = [x.split(" ")[0] for x in RECORD.split(", ")]
_KINDS = [pa.string()] * 8 + [pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary()]

_DROP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg)\b.*?(?:</\1\s*>|\Z)", re.S | re.I)
_BLOCK = re.compile(r"</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|head|header|hr|html|body|li|main|nav|ol|p|pre|section|table|tbody|td|th|thead|title|tr|ul)\b[^>]*>", re.I)
_TAG = re.compile(r"<[!/?a-zA-Z][^>]*>")
_TITLE, _TITLE_END = re.compile(r"<title\b[^>]*>", re.I), re.compile(r"</title\s*>", re.I)
_HTML, _LANG = re.compile(r"<html\b[^>]*>", re.I), re.compile(r"\blang\s*=\s*[\"']?([\w-]+)", re.I)
_A, _HREF = re.compile(r"<a\b[^>]*>", re.I), re.compile(r"\bhref\s*=", re.I)
#: Python's codecs that aren't character sets of pages.
_NO_CHARSET = {"idna", "punycode", "undefined", "unicode_escape", "raw_unicode_escape", "unicode-escape", "raw-unicode-escape", "mbcs", "oem", "utf-7", "utf_7", "utf7"}


def _closed(page: str) -> int:
    """The end of the page's last '>': before it every tag is closed, so that patterns which run to a '>' take linear time."""
    return page.rfind(">") + 1


def plain_text(page: str) -> str:
    """The page's text: without scripts, styles, comments and tags; block elements end lines, and character references are read.

    A tag that the page doesn't close is text. The time is linear in the page's length.
    """
    text = _DROP.sub(" ", page)
    for tag, to in ((_BLOCK, "\n"), (_TAG, "")):
        end = _closed(text)
        text = tag.sub(to, text[:end]) + text[end:]
    text = html.unescape(text) if "&" in text else text
    return "\n".join(filter(None, (" ".join(x.split()) for x in text.split("\n"))))


def said(page: str) -> tuple[str, str, int]:
    """What a page says of itself: its title, its language, and how many links it has."""
    tags = page[: _closed(page)]
    title, root = _TITLE.search(tags), _HTML.search(tags)
    end = _TITLE_END.search(page, title.end()) if title else None
    lang = _LANG.search(root[0]) if root else None
    return " ".join(plain_text(page[title.end() : end.start()]).split()) if end else "", lang[1].lower() if lang else "", sum(_HREF.search(m[0]) is not None for m in _A.finditer(tags))


def _utf8(text: str) -> bytes:
    return text.encode("utf-8", "replace")


_PAIRS = [base64.b32encode(bytes([i >> 2, i << 6 & 255])).decode()[:2] for i in range(1024)]


def sha1(content: bytes) -> str:
    """The digest as WARC files write it, in base 32 (ten bits at a time)."""
    n = int.from_bytes(hashlib.sha1(content).digest())
    return "sha1:" + "".join([_PAIRS[n >> s & 1023] for s in range(150, -1, -10)])


def record_id(*parts: str) -> str:
    """A URN that depends on the parts alone, so that reruns agree."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(chr(0).join(parts).encode()).digest()[:16], version=5)}>"


def response_of(key: str, url: str, page: str, date: str = DATE) -> dict:
    """The response record of a page: an HTTP message with the page as payload."""
    body = _utf8(page)
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    block = head + body
    return _record(record_id("response", key, url, hashlib.sha256(body).hexdigest()), "response", None, url, date, "application/http; msgtype=response", sha1(body), block, {})


def _record(rid, kind, refers_to, uri, date, content_type, payload, block: bytes, headers: dict) -> dict:
    return dict(zip(_NAMES, (rid, kind, refers_to, uri, date, content_type, payload, sha1(block), len(block), headers, block)))


def split_http(block: bytes) -> tuple[str, dict[str, str], bytes]:
    """Status line, headers in lower case, and body (without chunked or gzip coding) of an HTTP message.

    Chunks are read up to the first broken one; a body that isn't gzip, or breaks off, is left as it is.
    """
    head, _, body = block.partition(b"\r\n\r\n")
    status, *lines = head.decode("iso-8859-1").split("\r\n")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines) if k.strip()}
    if headers.get("transfer-encoding", "").lower() == "chunked":
        out, at = [], 0
        while (end := body.find(b"\r\n", at)) >= 0:
            try:
                n = int(body[at:end].split(b";")[0], 16)
            except ValueError:
                break
            if n <= 0:
                break
            out.append(body[end + 2 : end + 2 + n])
            at = end + 2 + n + 2
        body = b"".join(out)
    if headers.get("content-encoding", "").lower() in ("gzip", "x-gzip"):
        try:
            body = gzip.decompress(body)
        except (OSError, EOFError, zlib.error):
            pass
    return status, headers, body


def _decoded(headers: dict[str, str], body: bytes) -> str:
    """The body by the charset of its headers; by UTF-8 if there is none or it isn't known."""
    found = re.search(r"charset=[\"']?([\w-]+)", headers.get("content-type", ""), re.I)
    charset = found[1].lower() if found else "utf-8"
    try:
        return body.decode("utf-8" if charset in _NO_CHARSET else charset, "replace")
    except (LookupError, ValueError):
        return body.decode("utf-8", "replace")


def derivatives(response: dict) -> list[dict]:
    """The metadata and the conversion record of a response record.

    Both refer to it by WARC-Refers-To and keep its target and date. The metadata holds the source's status, HTTP headers and
    digests, as application/warc-fields, and what the page says of itself; the conversion holds the plain text.
    """
    uri, date, rid = response["target_uri"] or "", response["warc_date"] or DATE, response["record_id"]
    # A response without an id: its derivatives refer to none, and have ids of its target, date and content.
    key = (rid,) if rid else ("", uri, date, sha1(response["content"] or b""))
    status, http, body = split_http(response["content"] or b"")
    page = _decoded(http, body)
    text = _utf8(plain_text(page))
    kept = {"WARC-Source-Payload-Digest": response["payload_digest"] or sha1(body), "WARC-Source-Block-Digest": response["block_digest"] or sha1(response["content"] or b"")}
    conversion = _record(record_id("conversion", *key), "conversion", rid, uri, date, "text/plain; charset=utf-8", sha1(text), text, kept)
    title, lang, links = said(page)
    fields = [("status", status), *((f"http-{k}", v) for k, v in sorted(http.items())), ("source-payload-digest", kept["WARC-Source-Payload-Digest"]), ("source-block-digest", kept["WARC-Source-Block-Digest"])]
    fields += [("conversion-record-id", conversion["record_id"]), ("conversion-payload-digest", conversion["payload_digest"]), ("title", title), ("lang", lang), ("links", str(links)), ("text-bytes", str(len(text)))]
    block = _utf8("".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in fields))
    return [_record(record_id("metadata", *key), "metadata", rid, uri, date, "application/warc-fields", sha1(block), block, kept), conversion]


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({n: pa.array([list(r[n].items()) if n == "headers" else r[n] for r in rows], k) for n, k in zip(_NAMES, _KINDS)})


def responses(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Response records of pages; a null page is an empty one, a null url an empty target, a null id an empty key.

    Repeated rows give repeated records, an empty table none. Long pages are whole; other columns are ignored.
    """
    src = pages.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_i"), F.coalesce(F.col(url_col), F.lit("")).alias("_u"), common.text_of(html_col).alias("_t"))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return _batch([response_of(*x) for x in zip(*(b.column(c).to_pylist() for c in ("_i", "_u", "_t")))])

    return common.map_text(src, run, RECORD)


def derive(records: DataFrame) -> DataFrame:
    """Metadata and conversion records of the response records among the rows; other records are passed over.

    One pass without a shuffle. A record without content has an empty conversion. Record ids depend on the response's
    id alone; without one, on its target, date and content. Broken HTTP, gzip and HTML is read as far as it goes.
    Repeated responses give repeated records; an empty table gives none. Long pages are whole, in time linear in
    their length. Other columns are ignored.
    """
    small = records.where(F.col("warc_type") == "response").select(*_NAMES)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = b.to_pylist()
        return _batch([d for r in rows for d in derivatives(r)])

    return common.map_text(small, run, RECORD, col="content")


def derive_pages(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """derive(responses(pages)) in one step, with the page's id, of any type, as source_id before the record's columns. Cases as there."""
    kind = pages.schema[id_col].dataType.simpleString()
    src = pages.select(F.col(id_col).alias("_i"), F.coalesce(F.col(url_col), F.lit("")).alias("_u"), common.text_of(html_col).alias("_t"))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        ids, rows = [], []
        for i, u, t in zip(b.column("_i"), b.column("_u").to_pylist(), b.column("_t").to_pylist()):
            key = i.as_py()
            rows += derivatives(response_of("" if key is None else str(key), u, t))
            ids += [key, key]
        body = _batch(rows)
        return pa.RecordBatch.from_arrays([pa.array(ids, b.column("_i").type), *body.columns], ["source_id", *_NAMES])

    return common.map_text(src, run, f"source_id {kind}, {RECORD}")


def to_bytes(record: dict, compress: bool = True) -> bytes:
    """A record of a WARC/1.1 file, as a gzip member of its own."""
    named = [("WARC-Type", record["warc_type"]), ("WARC-Record-ID", record["record_id"]), ("WARC-Date", record["warc_date"]), ("WARC-Target-URI", record["target_uri"]), ("WARC-Refers-To", record["refers_to"])]
    named += [("WARC-Payload-Digest", record["payload_digest"]), ("WARC-Block-Digest", record["block_digest"]), *sorted((record["headers"] or {}).items()), ("Content-Type", record["content_type"]), ("Content-Length", str(len(record["content"] or b"")))]
    out = "WARC/1.1\r\n".encode() + "".join(f"{k}: {v}\r\n" for k, v in named if v).encode() + b"\r\n" + (record["content"] or b"") + b"\r\n\r\n"
    return gzip.compress(out, mtime=0) if compress else out


_FIELDS = {"warc-type": "warc_type", "warc-record-id": "record_id", "warc-date": "warc_date", "warc-target-uri": "target_uri", "warc-refers-to": "refers_to", "warc-payload-digest": "payload_digest", "warc-block-digest": "block_digest", "content-type": "content_type"}


def parse(data: bytes) -> Iterator[dict]:
    """The records of a WARC file, compressed by record or not; a broken record and what follows it are left out."""
    f = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data))
    try:
        while line := f.readline():
            if not line.startswith(b"WARC/"):
                continue
            head = []
            while (line := f.readline()) not in (b"\r\n", b"\n", b""):
                head.append(line)
            row, length = _fields(head)
            row["content"] = f.read(length)
            if len(row["content"]) < length:
                return
            yield row
    except (OSError, EOFError, ValueError, zlib.error):
        return


def _fields(lines: list[bytes]) -> tuple[dict, int]:
    """A record without its content, from the lines of its header, and the content's length. ValueError if that isn't a length."""
    row: dict = dict.fromkeys(_NAMES) | {"headers": {}, "content": b""}
    length = 0
    for line in lines:
        k, _, v = line.decode("utf-8", "replace").partition(":")
        k, v = k.strip(), v.strip()
        if k.lower() == "content-length":
            length = int(v)
        elif k.lower() in _FIELDS:
            row[_FIELDS[k.lower()]] = v
        elif k:
            row["headers"][k] = v
    if length < 0:
        raise ValueError("a negative length")
    row["content_length"] = length
    return row, length


#: What parts the records of a file for Spark's text reader, and for the writer.
_BEGIN, _END = "WARC/1.", "\r\n\r\n"


def write_warc(records: DataFrame, path: str) -> None:
    """Write the records into a new folder of .warc.gz files, one for each partition, by Spark's own writer (one gzip stream a file)."""
    def run(b: pa.RecordBatch) -> dict:
        rows = (to_bytes(r | {"headers": dict(r["headers"] or {})}, False) for r in b.to_pylist())
        return {"value": pa.array([x.removesuffix(_END.encode()) for x in rows], pa.binary())}

    spark = records.sparkSession
    raw = common.map_text(records.select(*_NAMES), run, "value binary", col="content")
    raw.select(F.col("value").cast("string")).write.option("lineSep", _END).option("compression", "gzip").text(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for f in fs.listStatus(folder):
        name = f.getPath().getName()
        if name.endswith(".txt.gz"):
            fs.rename(f.getPath(), spark._jvm.org.apache.hadoop.fs.Path(folder, name.removesuffix(".txt.gz") + ".warc.gz"))


def read_warc(spark: SparkSession, path: str, pattern: str = "*.warc*") -> DataFrame:
    """The records of WARC files (plain or gzip) under a path, through Spark's text reader, a record at a time.

    A task holds one record, whatever the size of its file. A payload may hold what looks like the beginning of a record: a
    record goes on until it has its length. (Plain files are read in splits; there such a payload that also lies
    across two splits is broken.) Broken records are left out, and so is what follows a break of the compression.
    """
    lines = spark.read.option("lineSep", _BEGIN).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").text(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, need, rows = b"", 0, []
        for batch in batches:
            for piece in batch.column("value").to_pylist():
                if open_:
                    open_ += _BEGIN.encode() + piece
                elif piece[:3] in (b"0\r\n", b"1\r\n"):
                    open_, need = piece, 0
                else:
                    continue
                if len(open_) < need:
                    continue
                head, blank, content = open_[3:].partition(b"\r\n\r\n")
                try:
                    row, length = _fields(head.split(b"\r\n"))
                except ValueError:
                    open_ = b""
                    continue
                if blank and len(content) < length:
                    need = 3 + len(head) + 4 + length
                    continue
                open_ = b""
                if blank:
                    rows.append(row | {"content": content[:length]})
                if len(rows) == 64:
                    yield _batch(rows)
                    rows = []
        yield _batch(rows)

    common.small_batches(spark)
    return lines.select(F.col("value").cast("binary")).mapInArrow(run, RECORD)


def records_of(chunks: DataFrame) -> DataFrame:
    """The records of chunks (data binary) of WARC files; a chunk is whole records, and is held by a task as one value."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column("data").to_pylist():
                rows = []
                for r in parse(data or b""):
                    rows.append(r)
                    if len(rows) == 256:
                        yield _batch(rows)
                        rows = []
                yield _batch(rows)

    common.small_batches(chunks.sparkSession)
    return chunks.select("data").mapInArrow(run, RECORD)


def op7_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = derive_pages(common.table(spark, sf_dir, "pages"))
    return found.withColumnRenamed("source_id", "page_id").withColumn("content", F.decode("content", "UTF-8")).withColumn("headers", F.to_json("headers"))
