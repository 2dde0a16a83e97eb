"""WARC archives as a chunked record table.

``write_records`` makes WARC/1.1 records of rows ``(page_id, url, html)``. A
record is a run of chunk rows ``(record_id, chunk_no, n_chunks, data, digest)``
whose ``data``, joined in order, is the record: its header, an HTTP head, the
payload in pieces of ``CHUNK`` bytes, and the closing line ends. ``digest`` is
the SHA-256 of the payload up to and with the chunk, so that a reader verifies
every chunk as it comes. No step joins a record: writer and reader go from
piece to piece. The table is written as Parquet in the shared folder;
``export`` joins chunks to ``.warc`` files.

Of rows with equal payloads of at least ``MIN_SHARED`` bytes, the smallest
``page_id`` is the response, the others are revisit records without payload
that name it. Digests are shuffled for that; the revisits' row keys come back to the
payloads by a broadcast while they are few (``common.small_side``), by a shuffle join beyond.

``read_records`` streams the chunk rows: records of one chunk are read where
they are stored, longer ones are regrouped by record and sorted by chunk. ``read_files`` reads exported files
as they stand, header by header. A revisit names its response by record id, url and date
(``WARC-Refers-To``); the capture date is a parameter. ``remove_archive`` deletes a table that is no longer needed.

Defined cases: null html is an empty payload; a null ``page_id`` is a response
only if all equal payloads have none; rows that repeat the smallest ``page_id``
are responses too; null url becomes an empty target; an empty table gives an
empty archive; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.llm.common import prepare, small_side, spread_lookup, with_row_key
from trellis.session import cut_lineage, ensure_checkpoint_dir, remove_path

CHUNK = 1 << 18
MIN_SHARED = 100
VERSION, END = b"WARC/1.1\r\n", b"\r\n\r\n"
#: Capture time of records whose pages have none.
DATE = "1970-01-01T00:00:00Z"
TABLE = "record_id string, chunk_no bigint, n_chunks bigint, data binary, digest string"
READ = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def _line(name: str, value) -> bytes:
    """A header line; line ends inside a value would start another header and become %0D and %0A (a url is kept whole beside it)."""
    return f"{name}: {value}".replace("\r", "%0D").replace("\n", "%0A").encode() + b"\r\n"


def _number(value: int | None) -> str:
    return "" if value is None else str(value)


def record_chunks(record_id: str, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None,
                  revisit: bool, size: int, sha: str, chunk: int, date: str = DATE, refers: tuple[str, str | None] | None = None) -> Iterator[tuple[int, int, bytes, str]]:
    """Chunks ``(chunk_no, n_chunks, data, digest)`` of a record, one at a time; ``refers``: record and url of a revisit's response."""
    head = b""
    if not revisit:
        head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + _line("Content-Length", size) + b"\r\n"
    lines = [VERSION, _line("WARC-Type", "revisit" if revisit else "response"), _line("WARC-Record-ID", f"<urn:uuid:{record_id}>"),
             _line("WARC-Date", date), _line("WARC-Target-URI", url or ""), _line("WARC-Payload-Digest", f"sha256:{sha}"), _line("X-Page-ID", _number(page_id)),
             _line("X-Payload-Length", size)]
    if "\r" in (url or "") or "\n" in (url or ""):
        lines.append(_line("X-Target-URI-Base64", base64.b64encode(url.encode()).decode()))
    if revisit:
        lines += [_line("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                  _line("X-Refers-To-Page", _number(refers_to))]
        if refers:
            lines += [_line("WARC-Refers-To", f"<urn:uuid:{refers[0]}>"), _line("WARC-Refers-To-Target-URI", refers[1] or ""), _line("WARC-Refers-To-Date", date)]
    else:
        lines.append(_line("Content-Type", "application/http;msgtype=response"))
    lines.append(_line("Content-Length", 0 if revisit else len(head) + size))
    n = 1 if revisit else max(1, -(-size // chunk))
    view, h = memoryview(payload), hashlib.sha256()
    for k in range(n):
        piece = b"" if revisit else view[k * chunk:(k + 1) * chunk]
        h.update(piece)
        yield k, n, (b"".join([*lines, b"\r\n", head, piece]) if k == 0 else bytes(piece)) + (END if k == n - 1 else b""), h.hexdigest()


def record_id(file: int, row: int) -> str:
    """A record's id, the same in every run: made of its row's key."""
    return str(uuid.uuid5(uuid.NAMESPACE_URL, f"{file}/{row}"))


def write_records(pages: DataFrame, chunk: int = CHUNK, date: str = DATE) -> DataFrame:
    """The chunk rows of a record per row of ``pages``; ``date`` is their capture time."""
    prepare(pages.sparkSession)
    keyed, keys = with_row_key(pages.select("page_id", "url", "html"))
    body = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = cut_lineage(keyed.select(*keys, F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
                                    F.octet_length(body).cast("bigint").alias("size"), F.sha2(body, 256).alias("sha")))
    shared = rows.where(F.col("size") >= MIN_SHARED)
    named = F.min_by(F.struct(*[F.col(k).alias(f"to_{k}") for k in keys], F.col("url").alias("to_url")), F.when(F.col("page_id").isNotNull(), F.struct("page_id", *keys)))
    groups = cut_lineage(shared.groupBy("sha").agg(
        F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"), named.alias("to")))
    many = cut_lineage(groups.where("n > 1"))
    # only groups with several rows can hold a revisit; the others need no lookup beyond the join's filter
    revisits = cut_lineage(spread_lookup(shared, many, ["sha"], "n", shared.count())
                           .where("NOT (page_id <=> first)").select(*keys, F.col("first").alias("refers_to"), "to"))
    src = (keyed.select(*keys, F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("body"))
           .join(small_side(revisits.withColumn("revisit", F.lit(True))), keys, "left")
           .select(*keys, "page_id", "url", "body", "refers_to", F.coalesce("revisit", F.lit(False)).alias("revisit"), *[f"to.to_{k}" for k in keys], "to.to_url"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(out):
            cols = list(zip(*out))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()),
                                               pa.array(cols[3], pa.binary()), pa.array(cols[4], pa.string())],
                                              ["record_id", "chunk_no", "n_chunks", "data", "digest"])
        for b in batches:
            out, held = [], 0
            for i in range(b.num_rows):
                f, r, page, url, body_, refers, revisit, to_f, to_r, to_url = (c[i] for c in b.columns)
                payload = body_.as_buffer()
                sha = hashlib.sha256(payload).hexdigest()
                rid = record_id(f.as_py(), r.as_py())
                to = (record_id(to_f.as_py(), to_r.as_py()), to_url.as_py()) if revisit.as_py() else None
                for k, n, data, digest in record_chunks(rid, page.as_py(), url.as_py(), payload, refers.as_py(), revisit.as_py(), payload.size, sha, chunk, date, to):
                    out.append((rid, k, n, data, digest))
                    held += len(data)
                    if held >= 16 * CHUNK:
                        yield packed(out)
                        out, held = [], 0
            if out:
                yield packed(out)

    return src.mapInArrow(run, TABLE)


def write_archive(pages: DataFrame, path: str, chunk: int = CHUNK, date: str = DATE) -> str:
    """Write the record table of ``pages`` to ``path`` (shared storage)."""
    write_records(pages, chunk, date).write.mode("errorifexists").parquet(path)
    return path


class _Reader:
    """Parses a record from its chunks in order; holds the header and running digest, never the payload."""

    def __init__(self, first: bytes, n_chunks: int):
        if not first.startswith(VERSION):
            raise ValueError("no WARC record")
        head, _, rest = first.partition(END)
        self.fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        self.revisit = self.fields["WARC-Type"] == "revisit"
        self.left = int(self.fields["Content-Length"])
        self.n, self.no, self.size, self.h = n_chunks, 0, 0, hashlib.sha256()
        if not self.revisit:
            http, _, body = rest.partition(END)
            self.left -= len(http) + len(END)
            rest = body
        self.rest = rest

    def take(self, data: bytes | None, no: int, digest: str) -> None:
        data = self.rest if data is None else data
        self.rest = b""
        if no != self.no:
            raise ValueError(f"chunk {no} where {self.no} is due")
        self.no += 1
        last = self.no == self.n
        piece = data[:len(data) - len(END)] if last else data
        if last and data[len(piece):] != END:
            raise ValueError("record without its end")
        self.h.update(piece)
        self.size += len(piece)
        self.left -= len(piece)
        if self.h.hexdigest() != digest:
            raise ValueError("chunk digest differs")

    def row(self) -> dict:
        f = self.fields
        sha, size = f["WARC-Payload-Digest"].removeprefix("sha256:"), int(f["X-Payload-Length"])
        if self.no != self.n or self.left or not self.revisit and (self.size != size or self.h.hexdigest() != sha):
            raise ValueError("record is not whole")
        refers = f.get("X-Refers-To-Page", "")
        url = base64.b64decode(f["X-Target-URI-Base64"]).decode() if "X-Target-URI-Base64" in f else f["WARC-Target-URI"]
        return {"page_id": int(f["X-Page-ID"]) if f["X-Page-ID"] else None, "url": url, "payload_bytes": size,
                "payload_digest": sha, "record_type": f["WARC-Type"], "refers_to": int(refers) if refers else None}


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(),
             "record_type": pa.string(), "refers_to": pa.int64()}
    open_, rid = None, None
    for b in batches:
        out = []
        for i in range(b.num_rows):
            record, no, n, data, digest = (c[i].as_py() for c in b.columns)
            if open_ is None:
                open_, rid, data = _Reader(data, n), record, None
            if record != rid:
                raise ValueError("record is not whole")
            open_.take(data, no, digest)
            if open_.no == open_.n:
                out.append(open_.row())
                open_ = None
        yield pa.RecordBatch.from_pydict({k: pa.array([r[k] for r in out], t) for k, t in kinds.items()})
    if open_ is not None:
        raise ValueError("record is not whole")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of an archive, each verified against its digests."""
    prepare(spark)
    t = spark.read.schema(TABLE).parquet(path)
    one = t.where("n_chunks = 1").mapInArrow(_read, READ)
    more = t.where("n_chunks > 1").repartition("record_id").sortWithinPartitions("record_id", "chunk_no").mapInArrow(_read, READ)
    return one.unionByName(more)


def export(spark: SparkSession, path: str, folder: str, archives: int = 8) -> DataFrame:
    """Write ``.warc`` files, each by one task that appends chunk after chunk; returns ``(file, n_records, n_bytes)``.

    ``folder`` is a URI that pyarrow's file systems open on every executor.
    """
    prepare(spark)
    t = spark.read.schema(TABLE).parquet(path)
    parts = (t.withColumn("archive", F.pmod(F.xxhash64("record_id"), F.lit(archives))).repartition(archives, "archive")
             .sortWithinPartitions("archive", "record_id", "chunk_no").select("archive", "chunk_no", "data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root)
        out, sink, now, totals = [], None, None, [0, 0]

        def close():
            if sink is not None:
                sink.close()
                system.move(f"{root}/{now}.part", f"{root}/part-{now:05d}.warc")
                out.append((f"part-{now:05d}.warc", *totals))
        for b in batches:
            for i in range(b.num_rows):
                a, no, data = (c[i].as_py() for c in b.columns)
                if a != now:
                    close()
                    now, totals = a, [0, 0]
                    sink = system.open_output_stream(f"{root}/{now}.part")
                sink.write(data)
                totals[0] += no == 0
                totals[1] += len(data)
        close()
        if out:
            yield pa.RecordBatch.from_pydict({k: list(v) for k, v in zip(("file", "n_records", "n_bytes"), zip(*out))})

    return parts.mapInArrow(run, "file string, n_records bigint, n_bytes bigint")


def archive_folder(spark: SparkSession) -> str:
    """A new folder in the shared storage."""
    return f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"


def remove_archive(spark: SparkSession, path: str) -> None:
    """Delete an archive's table; frames that read it can no longer be used."""
    remove_path(spark, path)


def _file_records(stream, piece: int = CHUNK) -> Iterator[dict]:
    """Rows of the records of an open ``.warc`` file, one after another; holds a header and a piece of a payload."""
    held = b""

    def more() -> bool:
        nonlocal held
        data = stream.read(piece)
        held += data
        return bool(data)
    while held or more():
        while END not in held and more():
            pass
        head, found, held = held.partition(END)
        if not found or not head.startswith(VERSION):
            raise ValueError("no WARC record")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        left, h, size = int(fields["Content-Length"]), hashlib.sha256(), 0
        if fields["WARC-Type"] == "response":
            while END not in held[:left] and len(held) < left and more():
                pass
            http, found, rest = held[:left].partition(END)
            if not found:
                raise ValueError("no HTTP head")
            left -= len(http) + len(END)
            held = held[len(http) + len(END):]
        while left:
            if not held and not more():
                raise ValueError("record is not whole")
            part, held = held[:left], held[left:]
            h.update(part)
            size, left = size + len(part), left - len(part)
        while len(held) < len(END) and more():
            pass
        if not held.startswith(END):
            raise ValueError("record without its end")
        held = held[len(END):]
        sha, refers = fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields.get("X-Refers-To-Page", "")
        if fields["WARC-Type"] == "response" and h.hexdigest() != sha:
            raise ValueError("payload digest differs")
        url = base64.b64decode(fields["X-Target-URI-Base64"]).decode() if "X-Target-URI-Base64" in fields else fields["WARC-Target-URI"]
        yield {"page_id": int(fields["X-Page-ID"]) if fields.get("X-Page-ID") else None, "url": url, "payload_bytes": int(fields.get("X-Payload-Length", size)),
               "payload_digest": sha, "record_type": fields["WARC-Type"], "refers_to": int(refers) if refers else None}


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record of the ``.warc`` files of ``folder`` (a URI that pyarrow's file systems open), a file per task, each verified."""
    from pyarrow import fs
    prepare(spark)
    system, root = fs.FileSystem.from_uri(folder)
    names = sorted(f.path for f in system.get_file_info(fs.FileSelector(root)) if f.base_name.endswith(".warc"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system_, _ = fs.FileSystem.from_uri(folder)
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
        for b in batches:
            for path in b.column(0).to_pylist():
                out = []
                with system_.open_input_stream(path) as stream:
                    for row in _file_records(stream):
                        out.append(row)
                        if len(out) == 4096:
                            yield pa.RecordBatch.from_pylist(out, schema)
                            out = []
                yield pa.RecordBatch.from_pylist(out, schema)
    return spark.createDataFrame([(n,) for n in names], "path string").repartition(max(1, len(names)), "path").mapInArrow(run, READ)
