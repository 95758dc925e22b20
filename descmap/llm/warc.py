"""WARC archives with a two-level capture index.

Archives are written by Spark's own text writer, so their files are committed as those of
any table and need no folder but the shared one. As usual each record is a gzip member of its own; the
writer's separator is the gzip member of no bytes, which readers pass over. A file holds FILE_BYTES, and what one record has beyond. Payloads that
occur more than once are stored once, with the largest id; the other
records are revisits (profile identical-payload-digest) that refer to it.

The index has the captures of all files sorted by URL key (host labels reversed, then path) and id, in
compressed blocks of `BLOCK` lines, and a directory with the first key and id of every block. A lookup
searches the directory by halves, then the block it leads to, then reads the byte ranges of the records alone. `look_up` does
that for any number of captures at once: queries are dealt to blocks by the directory, each block is opened once, and a file's ranges are
read in order.

Null urls have no target line and an empty key; null and empty payloads are empty; null ids are smaller than
all others and no record refers to them. Rows that repeat the largest id of a payload are all
responses. Repeated rows are records as any other. Extra columns of pages are ignored.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from descmap.llm._util import checkpointed, column, matched, shared_dir, table

#: Bytes of one archive file, about (a store that Spark alone can read has it read as a whole).
FILE_BYTES = 64_000_000
#: Blocks whose edges a directory that is held and broadcast has at most (some 200 bytes each).
DIRECTORY = 1_000_000
#: Bytes of an archive that are read at once.
PIECE = 16384
#: Captures of one index block.
BLOCK = 1000
DATE = "2026-01-01T00:00:00Z"
END = "\r\n\r\n"
_EMPTY = gzip.compress(b"", mtime=0)
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HEX = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_of_hex(hex_col):
    """Base32 of 20 bytes given in hex: five hex digits are four digits to the base 32."""
    parts = [F.lpad(F.conv(F.substr(hex_col, F.lit(k), F.lit(5)), 16, 32), 4, "0") for k in range(1, 41, 5)]
    return F.translate(F.concat(*parts), _HEX, _BASE32)


def _record_id(page_id, digest):
    h = F.md5(F.concat_ws(" ", page_id.cast("string"), digest))
    cut = [F.substr(h, F.lit(a), F.lit(n)) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def records(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> DataFrame:
    """id, url, payload, digest (hex), kind and refers_to (the response's id) of every page."""
    rows = pages.select(column(pages, id_col).cast("bigint").alias("id"), column(pages, url).alias("url"), F.coalesce(column(pages, html), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    tops = rows.where(F.octet_length("payload") >= min_bytes).groupBy("digest").agg(F.max("id").alias("top"), F.count("*").alias("n")).where("n > 1 and top is not null").select("digest", "top")
    # Only digests that occur repeatedly are sent to the pages; payloads stay where they are as long as these are few.
    both = matched(rows, tops, "digest", "id")
    revisit = F.col("top").isNotNull() & ~F.col("id").eqNullSafe(F.col("top")) & (F.octet_length("payload") >= min_bytes)
    return both.select("id", "url", "payload", "digest", F.when(revisit, "revisit").otherwise("response").alias("kind"), F.when(revisit, F.col("top")).alias("refers_to"))


def write(recs: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """recs (as of `records`) as WARC 1.1 files below path."""
    id_, digest = F.col("id"), base32_of_hex(F.col("digest"))
    revisit = F.col("kind") == "revisit"
    size = F.octet_length("payload")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size.cast("string"), F.lit(END))
    line = lambda name, value: F.concat(F.lit(name + ": "), value)  # noqa: E731  null if the value is
    clean = F.replace(F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")), F.lit("\t"), F.lit("%09"))
    header = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        line("WARC-Type", F.col("kind")),
        line("WARC-Record-ID", _record_id(id_, F.col("digest"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", clean),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        F.when(revisit, line("WARC-Profile", F.lit(_PROFILE))),
        F.when(revisit, line("WARC-Refers-To", _record_id(F.col("refers_to"), F.col("digest")))),
        line("X-Page-ID", id_.cast("string")),
        F.when(revisit, line("X-Refers-To-Page-ID", F.col("refers_to").cast("string"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        line("Content-Length", (F.octet_length(http) + F.when(revisit, 0).otherwise(size)).cast("string")),
    )
    whole = F.concat(header, F.lit(END), http, F.when(revisit, "").otherwise(F.col("payload")), F.lit(END))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 0
        for b in batches:
            made, files = [], []
            for t in b.column(0).to_pylist():
                made.append(gzip.compress(t.encode(), 6, mtime=0))
                files.append(size // file_bytes)
                size += len(made[-1]) + len(_EMPTY)
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary()), pa.array(files, pa.int64())], names=["member", "file"])

    members = recs.select(whole.alias("whole")).mapInArrow(run, "member binary, file bigint")
    # The separator's characters are its bytes in this encoding; members go out as the bytes they are. Each task writes its first file, then its second ...
    out = members.select(F.col("member").cast("string").alias("value"), "file").write.option("encoding", "ISO-8859-1").option("lineSep", _EMPTY.decode("latin-1"))
    out.partitionBy("file").text(path)


def cleaned(url: str | None) -> str | None:
    """A url as records have it."""
    return None if url is None else url.replace("\r", "%0D").replace("\n", "%0A").replace("\t", "%09").strip()


def url_key(url: str | None) -> str:
    """Sort key of a url: host labels reversed, the scheme left out."""
    scheme, sep, rest = (url or "").partition("://")
    if not sep:
        return url or ""
    end = min([k for k in (rest.find(c) for c in "/?#") if k >= 0], default=len(rest))
    return ",".join(reversed(rest[:end].lower().split("."))) + ")" + (rest[end:] or "/")


def members(source) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, bytes decompressed) of each gzip member that has any, of bytes or of a file that is read in pieces."""
    f = io.BytesIO(source) if isinstance(source, bytes) else source
    at, held = 0, f.read(PIECE)
    while held:
        d, parts, size = zlib.decompressobj(31), [], 0
        while not d.eof:
            held = held or f.read(PIECE)
            if not held:
                raise ValueError(f"the member at byte {at} doesn't end")
            parts.append(d.decompress(held))
            size += len(held) - len(d.unused_data)
            held = d.unused_data
        if any(parts):
            yield at, size, b"".join(parts)
        at += size
        held = held or f.read(PIECE)


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields by lower-case name, and the block."""
    end = record.index(b"\r\n\r\n")
    lines = record[:end].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(fields["content-length"])
    if record[end + 4 + n :] != END.encode():
        raise ValueError("the record's length is wrong")
    return fields, record[end + 4 : end + 4 + n]


def payload_of(block: bytes) -> tuple[int, bytes]:
    """Length of the whole payload, as the HTTP header says, and the payload that is there."""
    head, _, body = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return size, body


_CAPTURE = "key string, id bigint, digest string, bytes bigint, kind string, refers_to bigint, file string, at bigint, size bigint"


def captures(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the archives below path: what its headers say, and where it stands."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    try:
        open_store(path)
        files = files.select("path")
    except (pa.ArrowInvalid, OSError, NotImplementedError):
        # A store that Spark alone can read has whole files (FILE_BYTES each).
        files = files.select("path", "content")
    names, kinds = [x.split()[0] for x in _CAPTURE.split(", ")], (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, whole in enumerate(b.column(0).to_pylist()):
                name, made = "/".join(whole.split("/")[-2:]), []
                if b.num_columns > 1:
                    source = pa.BufferReader(b.column(1)[k].as_buffer())
                else:
                    fs, base = open_store(path)
                    source = fs.open_input_stream(f"{base}/{name}", buffer_size=PIECE * 16)
                with source:
                    for at, size, record in members(source):
                        f, block = parse(record)
                        ids = [int(f[x]) if x in f else None for x in ("x-page-id", "x-refers-to-page-id")]
                        made.append((url_key(f.get("warc-target-uri")), ids[0], f["warc-payload-digest"].removeprefix("sha1:"), payload_of(block)[0], f["warc-type"], ids[1], name, at, size))
                        if len(made) >= 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), kinds, strict=True)], names=names)
                            made = []
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), kinds, strict=True)], names=names)

    return files.mapInArrow(run, _CAPTURE)


def build_index(caps: DataFrame, path: str, block: int = BLOCK) -> None:
    """Writes blocks (compressed lines in order of key) and the directory of their first keys below path."""
    # Written first: the sort by ranges reads its input twice, once for a sample.
    ranged = checkpointed(caps).repartitionByRange("key", "id", "file", "at").sortWithinPartitions("key", "id", "file", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []
        keys: list[tuple[str, int | None]] = []

        count = TaskContext.get().partitionId() << 32

        def made(k: int) -> pa.RecordBatch:
            nonlocal count
            blob = zlib.compress("\n".join(held[:k]).encode(), 6)
            out = pa.RecordBatch.from_arrays([pa.array([count], pa.int64()), pa.array([keys[0][0]]), pa.array([keys[0][1]], pa.int64()), pa.array([keys[k - 1][0]]), pa.array([keys[k - 1][1]], pa.int64()), pa.array([k], pa.int64()), pa.array([blob], pa.binary())], names=["block", "first", "first_id", "last", "last_id", "n", "lines"])
            count += 1
            del held[:k], keys[:k]
            return out

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                keys.append(row[:2])
                held.append("\t".join("" if v is None else str(v) for v in row))
                if len(held) >= block:
                    yield made(block)
        if held:
            yield made(len(held))

    ranged.mapInArrow(run, "block bigint, first string, first_id bigint, last string, last_id bigint, n bigint, lines binary").write.parquet(f"{path}/blocks")
    blocks = caps.sparkSession.read.parquet(f"{path}/blocks")
    blocks.drop("lines").orderBy("first", "first_id", "last", "last_id", "block").write.parquet(f"{path}/directory")


def read_lines(blob: bytes) -> list[list[str]]:
    return [x.split("\t") for x in zlib.decompress(blob).decode().split("\n")]


def _place(key: str, id_: int | None) -> tuple:
    """What captures are sorted by; null ids come first."""
    return key, id_ is not None, id_ or 0


class Directory:
    """First and last keys of all blocks in order, for lookups; `most` blocks at most."""

    def __init__(self, spark: SparkSession, index: str, most: int = DIRECTORY):
        self.index = index
        rows = spark.read.parquet(f"{index}/directory").orderBy("first", "first_id", "last", "last_id", "block")
        n = rows.count()
        if n > most:
            raise ValueError(f"{n} blocks: filter the directory table by key instead of holding it")
        got = rows.toArrow()
        self.number = got.column("block").to_pylist()
        self.first, self.last = ([_place(*x) for x in zip(got.column(k).to_pylist(), got.column(f"{k}_id").to_pylist(), strict=True)] for k in ("first", "last"))

    def blocks(self, low: tuple, high: tuple) -> range:
        """Numbers of the blocks that may have captures from low to high."""
        return range(bisect.bisect_left(self.last, low), bisect.bisect_right(self.first, high))

    def captures(self, spark: SparkSession, url: str) -> list[list[str]]:
        """Lines of all captures of a url."""
        key = url_key(url)
        at = self.blocks((key,), (key, True, 2**63))
        if not at:
            return []
        blocks = spark.read.parquet(f"{self.index}/blocks").where(F.col("block").isin([self.number[k] for k in at])).select("lines")
        out = []
        for r in blocks.toLocalIterator():
            lines = read_lines(r.lines)
            a = bisect.bisect_left(lines, key, key=lambda x: x[0])
            b = bisect.bisect_right(lines, key, key=lambda x: x[0])
            out += lines[a:b]
        return sorted(out)


def _columns(lines: list) -> pa.Table:
    """A table of _CAPTURE from lines of the index."""
    names = [x.split()[0] for x in _CAPTURE.split(", ")]
    numbers = {1, 3, 5, 7, 8}
    cols = list(zip(*lines, strict=True)) if lines else [()] * len(names)
    return pa.table([pa.array([int(v) if v else None for v in c], pa.int64()) if k in numbers else pa.array(c, pa.string()) for k, c in enumerate(cols)], names=names)


def look_up(spark: SparkSession, index: str, wanted: DataFrame) -> DataFrame:
    """Captures (as of `captures`) of the urls and ids that wanted (url, id) has, all of them for each different pair.

    The directory is broadcast, and checked to be small enough for that; each query is searched in it by halves
    and goes to the block it may stand in (several if repeated captures go on from one to the next), which is opened once and searched by halves.
    """
    directory = spark.sparkContext.broadcast(Directory(spark, index))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = directory.value
        for b in batches:
            rows = []
            for url, id_ in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                key = url_key(cleaned(url))
                p = _place(key, id_)
                rows += [(d.number[k], key, id_) for k in d.blocks(p, p)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int64()))], names=["block", "key", "id"])

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        queries = {_place(*x) for x in zip(left.column("key").to_pylist(), left.column("id").to_pylist(), strict=True)}
        if queries:
            for blob in right.column("lines").to_pylist():
                lines = read_lines(blob)
                at = [_place(x[0], int(x[1]) if x[1] else None) for x in lines]
                for q in queries:
                    found += lines[bisect.bisect_left(at, q) : bisect.bisect_right(at, q)]
        return _columns(found)

    queries = wanted.select("url", F.col("id").cast("bigint").alias("id")).distinct().mapInArrow(deal, "block bigint, key string, id bigint")
    blocks = spark.read.parquet(f"{index}/blocks").select("block", "lines")
    return queries.groupBy("block").cogroup(blocks.groupBy("block")).applyInArrow(search, _CAPTURE)


def read_records(spark: SparkSession, archive: str, caps: DataFrame, payload: bool = True) -> DataFrame:
    """id, digest, kind, refers_to, bytes (of the whole payload, as the record says) and payload (a revisit's: empty) of captures, read from their byte ranges; payloads are held against their digests. Without payload they are read and held against these as well, but stay in the worker."""
    made = pa.schema([("id", pa.int64()), ("digest", pa.string()), ("kind", pa.string()), ("refers_to", pa.int64()), ("bytes", pa.int64()), *([("payload", pa.binary())] if payload else [])])

    def parsed(members: list[bytes]) -> list[tuple]:
        rows = []
        for m in members:
            f, block = parse(gzip.decompress(m))
            digest = f["warc-payload-digest"].removeprefix("sha1:")
            n, body = payload_of(block)
            if f["warc-type"] == "response" and (len(body) != n or base64.b32encode(hashlib.sha1(body).digest()).decode() != digest):
                raise ValueError(f"page {f.get('x-page-id')}: the payload doesn't match its digest")
            ids = [int(f[k]) if k in f else None for k in ("x-page-id", "x-refers-to-page-id")]
            rows.append((ids[0], digest, f["warc-type"], ids[1], n, *([body] if payload else [])))
        return rows

    def table_of(rows: list[tuple]) -> list[pa.Array]:
        return [pa.array([r[k] for r in rows], f.type) for k, f in enumerate(made)]

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, source = None, None
        try:
            for b in batches:
                rows, size = [], 0
                for file, at, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if file != name:
                        if source is not None:
                            source.close()
                        fs, base = open_store(archive)
                        name, source = file, fs.open_input_file(f"{base}/{file}")
                    source.seek(at)
                    rows += parsed([source.read(n)])
                    size += rows[-1][4]
                    if size > 8_000_000:
                        yield pa.RecordBatch.from_arrays(table_of(rows), schema=made)
                        rows, size = [], 0
                yield pa.RecordBatch.from_arrays(table_of(rows), schema=made)
        finally:
            if source is not None:
                source.close()

    def slices(left: pa.Table, right: pa.Table) -> pa.Table:
        content = memoryview(right.column("content")[0].as_buffer()) if right.num_rows else b""
        return pa.Table.from_arrays(table_of(parsed([bytes(content[at : at + n]) for at, n in zip(left.column("at").to_pylist(), left.column("size").to_pylist(), strict=True)])), schema=made)

    ddl = "id bigint, digest string, kind string, refers_to bigint, bytes bigint" + ", payload binary" * payload
    places = caps.select("file", "at", "size")
    try:
        open_store(archive)
    except (pa.ArrowInvalid, OSError, NotImplementedError):
        # A store that Spark alone can read has whole files (FILE_BYTES each) for ranges.
        files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(archive)
        files = files.select(F.array_join(F.slice(F.split("path", "/"), -2, 2), "/").alias("file"), "content")
        return places.groupBy("file").cogroup(files.groupBy("file")).applyInArrow(slices, ddl)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return places.repartition(tasks, "file", F.floor(F.col("at") / 4_000_000)).sortWithinPartitions("file", "at").mapInArrow(ranges, ddl)


def open_store(path: str):
    """A file system and the path in it, for range reads in Python workers."""
    from pyarrow import fs

    return fs.FileSystem.from_uri("file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path)


def read_range(spark: SparkSession, path: str, at: int, size: int) -> bytes:
    """Bytes of a file in any store that Spark reads."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark._jsc.hadoopConfiguration()).open(p)
    try:
        stream.seek(at)
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, size))
    finally:
        stream.close()


def fetch(spark: SparkSession, archive: str, line: list[str]) -> bytes:
    """The payload (a revisit's: empty) of a capture line, by a range read."""
    member = read_range(spark, f"{archive}/{line[6]}", int(line[7]), int(line[8]))
    return payload_of(parse(gzip.decompress(member))[1])[1]


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all pages to archives, indexes these, looks every page's capture up in the index and reads its record back from its byte range."""
    base = shared_dir(spark)
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    write(records(pages), f"{base}/archive")
    build_index(captures(spark, f"{base}/archive"), f"{base}/index")
    caps = look_up(spark, f"{base}/index", pages.select("url", F.col("page_id").alias("id")))
    got = read_records(spark, f"{base}/archive", caps, payload=False)
    return got.select(F.col("id").alias("page_id"), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to")


def op5_sql() -> str:
    digit = f"substr('{_BASE32}', ((('0x' || substr(x, (i // 4 * 5 + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT + 1, 1)"
    return f"""
    WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
    t AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS top FROM p)
    SELECT page_id, payload_bytes::BIGINT AS payload_bytes, array_to_string(list_transform(range(32), lambda i: {digit}), '') AS payload_digest,
      CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM t"""
