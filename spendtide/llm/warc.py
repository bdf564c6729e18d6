"""Web archives as a Spark source and sink: one gzip member per record.

    spark.dataSource.register(WarcSource)
    records.write.format("warc").mode("append").save(path)
    spark.read.format("warc").load(path)

A task reads a file from its start to its end: members are inflated piece by piece, records are cut
by their Content-Length, digests are checked on the way. Memory holds one piece, one head and, where
payloads are asked for, one batch of them.
"""

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from spendtide.llm.common import scratch, shared_folder, staged

#: Bytes read and inflated at a time; longest head; compressed bytes after which a task starts its next file.
PIECE, HEAD, FILE_BYTES = 1 << 16, 1 << 20, 1 << 28
#: Rows and payload bytes of a batch.
BATCH_ROWS, BATCH_BYTES = 1000, 1 << 24

# Names and forms of the WARC 1.1 format.
VERSION, EOL, END, MAGIC = b"WARC/1.1", b"\r\n", b"\r\n\r\n", b"\x1f\x8b\x08"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "application/http; msgtype=response"

RECORD = (
    "file string, offset bigint, record_id string, record_type string, uri string, date string, refers_to string, "
    "payload_bytes bigint, payload_digest string, payload binary, error string"
)
#: What the sink takes: payload and its length are the full ones, also of a revisit, whose payload is not stored.
TO_WRITE = "record_id string, record_type string, uri string, date string, refers_to string, payload_bytes bigint, payload_digest string, payload binary"


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    fs, at = pafs.FileSystem.from_uri(path) if re.match(r"\w+:", path) else (pafs.LocalFileSystem(), path)
    return fs, at.rstrip("/")


def _header_text(value: str) -> str:
    """A header's value on one line: control characters and blanks as an URI writes them."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def _label(sha1: bytes) -> str:
    return "sha1:" + base64.b32encode(sha1).decode()


def _unlabel(text: str | None) -> str | None:
    """Hexadecimal digits of a labelled SHA-1, which writers give in base 32 or 16."""
    name, _, digest = (text or "").partition(":")
    try:
        raw = bytes.fromhex(digest) if len(digest) == 40 else base64.b32decode(digest.upper())
    except ValueError:
        return None
    return raw.hex() if name.lower() == "sha1" and len(raw) == 20 else None


def record_bytes(row: dict) -> bytes:
    """One record as a gzip member."""
    full, revisit = row["payload"] or b"", row["record_type"] == "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % row["payload_bytes"]
    block = http if revisit else http + full
    head = [
        ("WARC-Type", row["record_type"]), ("WARC-Record-ID", f"<{_header_text(row['record_id'])}>"), ("WARC-Date", row["date"]),
        ("WARC-Target-URI", None if row["uri"] is None else _header_text(row["uri"])),
        ("WARC-Payload-Digest", _label(bytes.fromhex(row["payload_digest"]))),
        ("WARC-Block-Digest", _label(hashlib.sha1(block).digest())), ("Content-Type", HTTP),
        ("WARC-Refers-To", f"<{_header_text(row['refers_to'])}>" if revisit else None), ("WARC-Profile", SAME_PAYLOAD if revisit else None),
        ("Content-Length", str(len(block))),
    ]
    lines = [VERSION, *[f"{k}: {v}".encode("utf-8", "surrogatepass") for k, v in head if v is not None]]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(EOL.join(lines) + END) + pack.compress(block) + pack.compress(END) + pack.flush()


def _info() -> bytes:
    text = b"software: spendtide\r\nformat: WARC File Format 1.1\r\n"
    head = f"WARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(text)}"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(VERSION + EOL + head.encode() + END + text + END) + pack.flush()


class _Record:
    """A record that grows by pieces of its bytes."""

    def __init__(self, keep: bool):
        self.keep, self.head, self.fields, self.left = keep, b"", None, 0
        self.http, self.tail, self.block, self.payload = None, b"", hashlib.sha1(), hashlib.sha1()
        self.size, self.parts, self.http_size, self.done = 0, [], None, False

    def push(self, data: bytes) -> bytes:
        """Takes what is its own and returns the rest."""
        if self.fields is None:
            self.head += data
            head, found, data = self.head.partition(END)
            if not found:
                if len(self.head) > HEAD:
                    raise ValueError("no end of a record's head")
                return b""
            self._open(head)
        own, data = data[: self.left], data[self.left :]
        if own:
            self.left -= len(own)
            self.block.update(own)
            self._content(own)
        if not self.left and data:
            need = len(END) - len(self.tail)
            self.tail, data = self.tail + data[:need], data[need:]
            if not END.startswith(self.tail):
                raise ValueError("content is longer than its stated length")
            self.done = self.tail == END
        return data

    def _open(self, head: bytes) -> None:
        first, *lines = head.split(EOL)
        if not first.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        fields = [line.decode("utf-8", "replace").partition(":") for line in lines]
        self.fields = {k.strip().lower(): v.strip() for k, _, v in fields}
        length = self.fields.get("content-length", "")
        if not re.fullmatch(r"[0-9]+", length):
            raise ValueError("no Content-Length")
        self.left = int(length)
        self.http = b"" if self.fields.get("content-type", "").startswith("application/http") else None

    def _content(self, own: bytes) -> None:
        if self.http is not None:
            self.http += own
            head, found, own = self.http.partition(END)
            if not found:
                if len(self.http) > HEAD:
                    raise ValueError("no end of an HTTP head")
                return
            self.http = None
            stated = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", head)
            self.http_size = int(stated[1]) if stated else None
        self.payload.update(own)
        self.size += len(own)
        if self.keep:
            self.parts.append(own)

    def row(self) -> dict:
        f = self.fields or {}
        kind = f.get("warc-type")
        revisit, stated = kind == "revisit", _unlabel(f.get("warc-payload-digest"))
        wrong = None
        if self.fields is None or not self.done:
            wrong = "a record ends before its stated length"
        elif (d := _unlabel(f.get("warc-block-digest"))) and d != self.block.hexdigest():
            wrong = "block digest differs"
        elif not revisit and stated and stated != self.payload.hexdigest():
            wrong = "payload digest differs"
        bare = {k: v[1:-1] if (v := f.get(k)) and v[0] == "<" and v[-1] == ">" else v for k in ("warc-record-id", "warc-refers-to")}
        return {
            "record_id": bare["warc-record-id"], "record_type": kind, "uri": f.get("warc-target-uri"),
            "date": f.get("warc-date"), "refers_to": bare["warc-refers-to"],
            "payload_bytes": self.http_size if revisit else self.size,
            "payload_digest": stated if revisit else self.payload.hexdigest(),
            "payload": b"".join(self.parts) if self.keep and not revisit else None, "error": wrong,
        }


def _empty(error: str) -> dict:
    return {k: None for k in ("record_id", "record_type", "uri", "date", "refers_to", "payload_bytes", "payload_digest", "payload")} | {"error": error}


def read_stream(stream, keep: bool = False) -> Iterator[dict]:
    """Every record of an archive, in order, with the offset of its member.

    What is wrong gives a row with `error`: a damaged or cut member, a record without length, content shorter
    or longer than stated, a digest that differs. After a damaged member reading goes on at the next that
    opens as one.
    """
    at, data, lost = 0, b"", False
    while True:
        if not data and not (data := stream.read(PIECE)):
            return
        if lost:
            skip = data.find(MAGIC)
            if skip < 0:
                more = stream.read(PIECE)
                if not more:
                    return
                at, data = at + max(0, len(data) - 2), data[-2:] + more
                continue
            at, data = at + skip, data[skip:]
        start, inflate, record, framing, good = at, zlib.decompressobj(31), _Record(keep), None, False
        try:
            while not inflate.eof:
                if not data and not (data := stream.read(PIECE)):
                    if not lost:
                        yield _empty("the file ends within a member") | {"offset": start}
                    return
                out = inflate.decompress(data, PIECE)
                rest = inflate.unused_data if inflate.eof else inflate.unconsumed_tail
                at, data = at + len(data) - len(rest), rest
                while out and framing is None:
                    if record.done:
                        good = True
                        yield record.row() | {"offset": start}
                        record = _Record(keep)
                    try:
                        out = record.push(out)
                    except ValueError as e:
                        framing = str(e)
        except zlib.error as e:
            if not lost:
                yield _empty(f"damaged member: {e}") | {"offset": start}
            step = 1 if at == start else 0
            at, data, lost = at + step, data[step:], True
            continue
        if framing and not lost:
            yield record.row() | {"offset": start, "error": framing}
        elif not framing and (record.head or not good):
            yield record.row() | {"offset": start}
        lost = False


@dataclass
class _File(InputPartition):
    path: str


@dataclass
class _Written(WriterCommitMessage):
    names: tuple


class _Reader(DataSourceReader):
    def __init__(self, path: str, keep: bool):
        self.path, self.keep = path, keep

    def partitions(self):
        fs, at = _store(self.path)
        found = [fs.get_file_info(at)] if fs.get_file_info(at).is_file else fs.get_file_info(pafs.FileSelector(at))
        return [_File(f.path) for f in sorted(found, key=lambda f: f.path) if f.is_file and f.base_name.endswith(".warc.gz")]

    def read(self, partition):
        schema = pa.schema([(n, {"bigint": pa.int64(), "binary": pa.binary(), "string": pa.string()}[t]) for n, t in (c.split() for c in RECORD.split(", "))])
        if not hasattr(partition, "path"):  # a folder without archives
            return
        fs, _ = _store(self.path)
        rows, held = [], 0
        with fs.open_input_stream(partition.path, compression=None) as stream:
            for row in read_stream(stream, self.keep):
                rows.append(row | {"file": partition.path})
                held += len(row["payload"] or b"")
                if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


class _Writer(DataSourceArrowWriter):
    """Tasks write below a folder of this write's own; the commit moves what succeeded. A task that runs again leaves a file that nobody moves."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.own = path, overwrite, f"_writing-{uuid.uuid4().hex}"

    def write(self, iterator):
        fs, at = _store(self.path)
        task = TaskContext.get()
        fs.create_dir(f"{at}/{self.own}", recursive=True)
        names, out, size = [], None, 0
        try:
            for batch in iterator:
                for k in range(batch.num_rows):
                    if out is None or size >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        names.append(f"part-{task.partitionId():05d}-{len(names):04d}-{uuid.uuid4().hex}.warc.gz")
                        out, size = fs.open_output_stream(f"{at}/{self.own}/{names[-1]}", compression=None), 0
                        out.write(_info())
                    member = record_bytes(batch.slice(k, 1).to_pylist()[0])
                    out.write(member)
                    size += len(member)
        finally:
            if out is not None:
                out.close()
        return _Written(tuple(names))

    def commit(self, messages):
        fs, at = _store(self.path)
        fs.create_dir(at, recursive=True)
        if self.overwrite:
            for f in fs.get_file_info(pafs.FileSelector(at)):
                if f.is_file and f.base_name.endswith(".warc.gz"):
                    fs.delete_file(f.path)
        for m in messages:
            for name in m.names if m else ():
                fs.move(f"{at}/{self.own}/{name}", f"{at}/{name}")
        self.abort(messages)

    def abort(self, messages):
        fs, at = _store(self.path)
        if fs.get_file_info(f"{at}/{self.own}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{at}/{self.own}")


class WarcSource(DataSource):
    """Format `warc`. Reading takes the option `payload` (default false): whether payloads are returned."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return RECORD

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("payload", "false").lower() == "true")

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], overwrite)


#: Payloads from this length on are stored once.
LEAST = 1000


def captures(pages: DataFrame, page: Column, uri: Column, payload: Column, date: str, least: int = LEAST) -> DataFrame:
    """Records of `pages`, ready to be written: columns of TO_WRITE.

    Of equal payloads of at least `least` bytes that of the greatest page is the response and the others revisit it; a null
    page is less than any. Shorter ones are responses all. Rows that agree in page and payload are records
    of one id, of one kind. A null payload is empty, a null uri stays null; blanks and control characters of an uri come back percent-encoded.

    Only digests and ids of long payloads meet: one row per task and payload, however many copies there are. The copies
    then take their response in a join, whose large partitions Spark can split. `pages` is read twice, so pass a written table.
    """
    data = F.coalesce(payload, F.lit(b"").cast("binary"))
    rows = pages.select(
        page.cast("bigint").alias("page_"), uri.cast("string").alias("uri"), data.alias("payload"),
        F.octet_length(data).cast("bigint").alias("payload_bytes"), F.sha1(data).alias("payload_digest"),
        F.when(F.octet_length(data) >= least, F.sha2(data, 256)).alias("same_"),
    )
    long_ = rows.filter("same_ is not null").select("same_", "page_")
    heads = long_.groupBy("same_").agg(F.max("page_").alias("head_"), F.count("*").alias("copies_"))
    heads = staged(heads.filter("copies_ > 1").drop("copies_"), "heads")
    joined = rows.join(heads, "same_", "left")
    revisit = F.col("head_").isNotNull() & ~F.col("page_").eqNullSafe(F.col("head_"))
    return joined.select(
        record_id(F.col("page_"), F.col("payload_digest")).alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        "uri", F.lit(date).alias("date"), F.when(revisit, record_id(F.col("head_"), F.col("payload_digest"))).alias("refers_to"),
        "payload_bytes", "payload_digest", F.when(~revisit, F.col("payload")).alias("payload"),
    )


def record_id(page: Column, digest: Column) -> Column:
    return F.concat(F.lit("urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(":"), digest)


def page_of(id: Column) -> Column:
    return F.regexp_extract(id, "^urn:page:(-?[0-9]*):", 1).try_cast("bigint")


def write_archives(records: DataFrame, path: str) -> None:
    """`records` (columns of TO_WRITE) as files of up to FILE_BYTES below `path`."""
    spark = records.sparkSession
    spark.dataSource.register(WarcSource)
    columns = [c.split()[0] for c in TO_WRITE.split(", ")]
    records.select(*columns).write.format("warc").mode("append").save(path)


def read_archives(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """All records below `path`; see `read_stream` for what is wrong with some."""
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def resolved(records: DataFrame) -> DataFrame:
    """`records` read with payloads; revisits get the payload of the response they refer to.

    A revisit whose response is absent, or has another digest, keeps a null payload and gets an error.
    """
    kept = records.filter("record_type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("payload").alias("p_"), F.col("payload_digest").alias("d_")).dropDuplicates(["refers_to"])
    other = records.filter("record_type = 'revisit'").join(kept, "refers_to", "left")
    found = F.col("d_") == F.col("payload_digest")
    other = other.withColumns({
        "payload": F.when(found, F.col("p_")),
        "error": F.coalesce("error", F.when(F.coalesce(found, F.lit(False)), F.lit(None)).otherwise("the response it refers to is missing")),
    })
    return records.filter("record_type is distinct from 'revisit'").unionByName(other.select(*records.columns))


@scratch
def archived(pages: DataFrame, date: str, least: int = LEAST) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, uri, error): `pages` written as archives and read back.

    Columns page_id, url and html of `pages` count, others do not. Payloads are html in UTF-8; see `captures` for nulls, ties and
    repeated rows. An empty table gives no rows. Long pages: a page is one record, held once by the task that writes it; the
    reader holds pieces. The archives go when the result is written.
    """
    spark = pages.sparkSession
    rows = captures(pages, F.col("page_id"), F.col("url"), F.encode(F.col("html").cast("string"), "UTF-8"), date, least)
    at = shared_folder(spark, "archives")
    write_archives(rows, at)
    back = read_archives(spark, at).filter("record_type is distinct from 'warcinfo'")
    return staged(back.select(
        page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        page_of(F.col("refers_to")).alias("refers_to"), "uri", "error",
    ), "read-back", keep=True)
