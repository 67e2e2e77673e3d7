"""WARC archives and their two-level capture index.

Archives are files of gzip members, one record each, as other tools read them; Spark's own text
writer commits them, so a lost executor leaves no half file. The index sorts lines by reversed-host
key and page into compressed blocks; a sparse directory holds each block's first key and page, and where
it lies. A lookup bisects the shards' first ones, then the directory, and reads the block by range.
So are records: tasks seek to offsets in the shared file system and read just the captures' bytes.
"""

from __future__ import annotations

import hashlib
import math
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkshelf.checkpoints import cut, shared_folder

from .groups import dealt

REVISIT_BYTES = 1_000
BLOCK_LINES = 1_000
#: Lines of an index's shard, about, and at least where more shards would keep more cores busy.
SHARD_LINES, LEAST_LINES = 200_000, 5_000
#: Compressed bytes after which an archive ends, and those of a stretch of one that a task reads at once.
FILE_BYTES, STRETCH_BYTES = 64 << 20, 16 << 20
#: A gzip member ends with its input's size; below 16 MB the last byte is 0, which the writer adds as a line's end.
MEMBER_BYTES = 8 << 20
READ_BYTES, FED_BYTES = 1 << 20, 16 << 10
#: Captures whose bytes lie this near are read in one request of at most READ_BYTES or of one record.
GAP_BYTES = 16 << 10
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LINE = "`key` string, page_id long, record_type string, file string, `offset` long, `length` long"


def surt(url: str | None) -> str:
    """The key of a URL: its host's labels reversed, then port and path, without scheme, user or fragment; '' for null."""
    if not url:
        return ""
    rest = url.split("://", 1)[-1].split("#", 1)[0]
    host, slash, path = rest.partition("/")
    host, _, port = host.rpartition("@")[2].lower().partition(":")
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + slash + path
    return key.replace("\t", "%09").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record with the payload, or a revisit that names the response."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    of = lambda i: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page:{i}')}>"
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", of(page_id)), ("WARC-Date", DATE), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{hashlib.sha1(payload).hexdigest()}"), ("Content-Length", str(len(block)))]
    if url is not None:
        head.append(("WARC-Target-URI", quote(url, safe="".join(map(chr, range(0x21, 0x25))) + "".join(map(chr, range(0x26, 0x7F))))))
    if page_id is not None:
        head.append(("Page-ID", str(page_id)))
    if refers_to is not None:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", of(refers_to)), ("Refers-To-Page-ID", str(refers_to))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """The record as gzip members of at most MEMBER_BYTES, so that the last byte is 0."""
    out = []
    for at in range(0, len(data), MEMBER_BYTES):
        z = zlib.compressobj(5, zlib.DEFLATED, 31)
        out += [z.compress(data[at : at + MEMBER_BYTES]), z.flush()]
    return b"".join(out)


@dataclass
class Record:
    headers: dict[str, str]
    payload: bytes

    @property
    def page_id(self) -> int | None:
        return int(self.headers["Page-ID"]) if "Page-ID" in self.headers else None

    @property
    def refers_to(self) -> int | None:
        return int(self.headers["Refers-To-Page-ID"]) if "Refers-To-Page-ID" in self.headers else None

    @property
    def url(self) -> str | None:
        return unquote(self.headers["WARC-Target-URI"]) if "WARC-Target-URI" in self.headers else None


def parse(data: bytes) -> Record:
    """Of a record's whole bytes."""
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(headers["Content-Length"])]
    return Record(headers, block.partition(b"\r\n\r\n")[2])


def records(file) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, bytes) of each record of an archive that is read as a stream; a record may take several members."""
    at, begin, held, z = 0, 0, bytearray(), None
    while buffer := file.read(READ_BYTES):
        view, place = memoryview(buffer), 0
        while place < len(view):
            z = z or zlib.decompressobj(31)
            part = view[place : place + FED_BYTES]
            held += z.decompress(part)
            used = len(part) - len(z.unused_data)
            place, at = place + used, at + used
            if not z.eof:
                continue
            z = None
            head, mark, _ = bytes(held[: READ_BYTES]).partition(b"\r\n\r\n")
            if mark and len(held) >= len(head) + 8 + int(head.rpartition(b"Content-Length: ")[2].split(b"\r\n", 1)[0]):
                yield begin, at - begin, bytes(held)
                begin, held = at, bytearray()


def inflated(data: bytes) -> bytes:
    """The bytes of a record's members."""
    out = []
    while data:
        z = zlib.decompressobj(31)
        out.append(z.decompress(data))
        data = z.unused_data
    return b"".join(out)


def opened(uri: str):
    """A file of the shared file system, to seek in: by Arrow's own clients, as tasks in Python can't ask Spark's."""
    if uri.partition(":")[0] == "file":
        return fs.LocalFileSystem().open_input_file("/" + uri[5:].lstrip("/"))
    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


def write_archives(pages: DataFrame, path: str, revisit_bytes: int = REVISIT_BYTES, file_bytes: int = FILE_BYTES) -> None:
    """One record per row of pages (page_id, url, html), into files of about file_bytes (or one larger record) in the folder path/archive.

    Of rows with equal payloads of at least revisit_bytes, that of the largest page_id is the
    response and the others revisit it; rows that repeat that page_id are responses, too.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "bytes": F.octet_length("payload").cast("long")})
    several = rows.where(F.col("bytes") >= revisit_bytes).groupBy("digest", "bytes").agg(F.max("page_id").alias("original"), F.count("*").alias("n")).where("n > 1 and original is not null").drop("n")
    rows = rows.join(several, ["digest", "bytes"], "left")
    refers = F.when(F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original")), F.col("original"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, held = 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                packed = [member(record(i, u, p.as_py(), r))[:-1] for i, u, p, r in zip(part["page_id"].to_pylist(), part["url"].to_pylist(), part["payload"], part["refers_to"].to_pylist(), strict=True)]
                files = []
                for size in map(len, packed):
                    if held and held + size > file_bytes:
                        file, held = file + 1, 0
                    files.append(file)
                    held += size + 1
                yield pa.RecordBatch.from_arrays([pa.array(files, pa.int32()), pa.array(packed, pa.binary())], names=["file", "value"])

    packed = rows.select("page_id", "url", "payload", refers.alias("refers_to")).mapInArrow(pack, "file int, value binary")
    packed.select("file", F.col("value").cast("string")).write.partitionBy("file").option("lineSep", "\0").text(f"{path}/archive")


def _archives(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the archives; their bytes aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(f"{path}/archive").select("path", "length")


LINES = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch["path"].to_pylist():
            rows, name = [], path.rpartition("/archive/")[2]
            with opened(path) as file:
                for offset, length, data in records(file):
                    r = parse(data)
                    rows.append((surt(r.url), r.page_id, r.headers["WARC-Type"], name, offset, length))
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*rows, strict=True), LINES.types)), schema=LINES)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*rows, strict=True), LINES.types)), schema=LINES)


def _line(row: dict) -> str:
    return "\t".join([row["key"], "" if row["page_id"] is None else str(row["page_id"]), row["record_type"], row["file"], str(row["offset"]), str(row["length"])])


BLOCKS = "shard int, block int, first_key string, first_page long, `lines` int, `offset` long, `length` long, value binary"


def _blocks(lines: int):
    kinds = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("first_key", pa.string()), ("first_page", pa.int64()), ("lines", pa.int32()), ("offset", pa.int64()), ("length", pa.int64()), ("value", pa.binary())])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, shard, n, offset = [], 0, 0, 0

        def out(rows: list[dict]) -> pa.RecordBatch:
            nonlocal n, offset
            packed = member("\n".join(map(_line, rows)).encode())
            found = pa.RecordBatch.from_pydict({"shard": [shard], "block": [n], "first_key": [rows[0]["key"]], "first_page": [rows[0]["page_id"]], "lines": [len(rows)], "offset": [offset], "length": [len(packed)], "value": [packed[:-1]]}, kinds)
            n, offset = n + 1, offset + len(packed)
            return found

        for batch in batches:
            for row in batch.to_pylist():
                shard = row["shard"]
                held.append(row)
                if len(held) == lines:
                    yield out(held)
                    held = []
        if held:
            yield out(held)

    return blocks


def write_index(spark: SparkSession, path: str, block_lines: int = BLOCK_LINES, shard_lines: int = SHARD_LINES) -> None:
    """Scans the archives of `path` and writes path/index: a file of compressed blocks for each shard, and the directory (shard, block, first_key, first_page, lines, file, offset, length).

    Shards are ranges of about shard_lines lines by key, page, file and offset, so one URL's captures, and even
    those of one page, may take several; inside a shard, blocks of block_lines sorted lines are gzip
    members one behind another, each of which can be read alone.
    """
    lines = cut(_archives(spark, path).select("path").mapInArrow(_lines, LINE))
    n = lines.count()
    shards = max(1, -(-n // shard_lines), min(spark.sparkContext.defaultParallelism, n // LEAST_LINES))
    order = ["key", "page_id", "file", "offset"]
    ordered = lines.repartitionByRange(shards, *order).sortWithinPartitions(*order).withColumn("shard", F.spark_partition_id())
    blocks = cut(ordered.mapInArrow(_blocks(block_lines), BLOCKS))
    # each shard is in one task, in order: its file's offsets are known before it is written
    packed = blocks.sortWithinPartitions("shard", "block").select("shard", F.col("value").cast("string"))
    packed.write.partitionBy("shard").option("lineSep", "\0").text(f"{path}/index/blocks")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(f"{path}/index/blocks").select(F.regexp_extract("path", r"/index/blocks/(shard=\d+/[^/]*)$", 1).alias("file"))
    files = files.withColumn("shard", F.regexp_extract("file", r"^shard=(\d+)", 1).cast("int"))
    blocks.drop("value").join(files, "shard").sortWithinPartitions("shard", "block").write.parquet(f"{path}/index/directory")


def _place(key: str, page: int | None) -> tuple[str, bool, int]:
    """Orders lines as the index does: by key's bytes (as Python's strings), then page, null first."""
    return key, page is not None, page or 0


class Shard:
    """The directory of one shard's blocks, bisected for what is wanted, in order; read(i) gives the lines of block i, and is asked once for each."""

    def __init__(self, places: list[tuple[str, bool, int]], read: Callable[[int], bytes]):
        self.directory, self.read, self.held = places, read, -1
        self.rows: list[list[str]] = []
        self.places: list[tuple[str, bool, int]] = []

    def find(self, wanted: tuple[str, bool, int]) -> Iterator[list[str]]:
        """Lines (key, page, type, file, offset, length) of a place; those asked for must not go down."""
        at = max(0, bisect_left(self.directory, wanted) - 1)
        while at < len(self.directory) and self.directory[at] <= wanted:
            if at != self.held:
                self.rows = [x.split("\t") for x in self.read(at).decode().split("\n")]
                self.held, self.places = at, [_place(r[0], int(r[1]) if r[1] else None) for r in self.rows]
            yield from self.rows[bisect_left(self.places, wanted) : bisect_right(self.places, wanted)]
            at += 1


FOUND = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def _search(root: str):
    """Streams each shard's directory and then what is wanted of it, in order; reads the wanted blocks by range, and no other."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, index, directory, file = None, None, [], None

        def read(at: int) -> bytes:
            nonlocal file
            name, offset, length = directory[at][1:]
            if file is None:
                file = opened(f"{root}/{name}")
            return inflated(file.read_at(length, offset))

        rows: list[tuple] = []
        for batch in batches:
            for x in (y for at in range(0, batch.num_rows, 4096) for y in batch.slice(at, 4096).to_pylist()):
                if x["shard"] != shard:
                    if file is not None:
                        file.close()
                    shard, index, directory, file = x["shard"], None, [], None
                place = _place(x["key"], x["page_id"])
                if not x["role"]:
                    directory.append((place, x["file"], x["offset"], x["length"]))
                    continue
                index = index or Shard([d[0] for d in directory], read)
                rows += [(x["page_id"], f[2], f[3], int(f[4]), int(f[5])) for f in index.find(place)]
                if len(rows) > 10_000:
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*rows, strict=True), FOUND.types)), schema=FOUND)
                    rows = []
        if file is not None:
            file.close()
        if rows:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*rows, strict=True), FOUND.types)), schema=FOUND)

    return search


def look_up(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """(page_id, record_type, file, offset, length) of the captures wanted (url, page_id).

    A wanted row goes to the one shard that may hold its (key, page_id), or to all of them where
    its lines lie across borders. Only the shards' first keys and pages, one per shard, meet in the driver.
    The directory of shards that something is wanted of travels to the tasks, blocks don't: a task reads those that
    may hold what it wants, by range, each once. So one URL opens the directory and a block, or two at a block's border.
    """
    directory = spark.read.parquet(f"{path}/index/directory")
    firsts = sorted((_place(r.first_key, r.first_page), r.shard) for r in directory.where("block = 0").select("shard", "first_key", "first_page").collect())
    places, shards = [p for p, _ in firsts], [s for _, s in firsts]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            for url, page in zip(batch["url"].to_pylist(), batch["page_id"].to_pylist(), strict=True):
                k = surt(url)
                place = _place(k, page)
                low = max(0, bisect_left(places, place) - 1)
                for i in range(low, max(low + 1, bisect_right(places, place))):  # it may stand on both sides of a border
                    if shards:
                        for x, v in zip(out, (shards[i], k, page), strict=True):
                            x.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())], names=["shard", "key", "page_id"])

    asked = wanted.select("url", "page_id").mapInArrow(route, "shard int, `key` string, page_id long").distinct()
    none = lambda kind: F.lit(None).cast(kind)
    asked = asked.select("shard", F.lit(1).alias("role"), "key", "page_id", none("string").alias("file"), none("long").alias("offset"), none("long").alias("length"))
    used = directory.join(asked.select("shard").distinct(), "shard", "left_semi").select("shard", F.lit(0).alias("role"), F.col("first_key").alias("key"), F.col("first_page").alias("page_id"), "file", "offset", "length")
    # directory rows of one place stay in the order of their offsets
    both = dealt(used.unionByName(asked), ["shard"], "role", "key", "page_id", "offset")
    return both.mapInArrow(_search(f"{path}/index/blocks"), "page_id long, record_type string, file string, `offset` long, `length` long")


READ = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def _ranges(wanted: list[tuple[int, int]]) -> Iterator[tuple[int, int, int, int]]:
    """(offset, length, first, last) of requests that cover the sorted (offset, length): those near each other in one."""
    first = 0
    for i in range(1, len(wanted) + 1):
        begin = wanted[first][0]
        end = wanted[i - 1][0] + wanted[i - 1][1]
        if i == len(wanted) or wanted[i][0] - end > GAP_BYTES or wanted[i][0] + wanted[i][1] - begin > READ_BYTES:
            yield begin, max(end, max(o + n for o, n in wanted[first:i])) - begin, first, i
            first = i


def _read(root: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, file = None, None
        for batch in batches:
            names = batch["file"].to_pylist()
            wanted = list(zip(batch["offset"].to_pylist(), batch["length"].to_pylist(), strict=True))
            rows = []
            cuts = [i for i in range(len(names)) if not i or names[i] != names[i - 1]] + [len(names)]
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                if names[a] != held:
                    if file:
                        file.close()
                    held, file = names[a], opened(f"{root}/{names[a]}")
                for begin, size, x, y in _ranges(wanted[a:z]):
                    data = memoryview(file.read_at(size, begin))
                    for offset, length in wanted[a + x : a + y]:
                        r = parse(inflated(bytes(data[offset - begin : offset - begin + length])))
                        response = r.headers["WARC-Type"] == "response"
                        digest = hashlib.sha1(r.payload).hexdigest() if response else r.headers["WARC-Payload-Digest"].partition(":")[2]
                        rows.append((r.page_id, len(r.payload) if response else None, digest, r.headers["WARC-Type"], r.refers_to))
            if rows:
                yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*rows, strict=True), READ.types)), schema=READ)
        if file:
            file.close()

    return read


def read_captures(spark: SparkSession, path: str, captures: DataFrame, stretch: int = STRETCH_BYTES) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of captures (file, offset, length); a revisit's bytes are its response's.

    Captures are dealt to tasks by stretches of the archives; a task holds no more than one request's bytes and one record.
    """
    size = _archives(spark, path).agg(F.sum("length")).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, math.ceil(size / stretch))
    dealt = captures.select("file", "offset", "length").repartition(tasks, F.col("file"), F.floor(F.col("offset") / stretch)).sortWithinPartitions("file", "offset")
    got = cut(dealt.mapInArrow(_read(f"{path}/archive"), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"))
    responses = got.where("record_type = 'response'").groupBy(F.col("page_id").alias("_to"), F.col("payload_digest").alias("_digest")).agg(F.max("payload_bytes").alias("_bytes"))
    whole = got.join(responses, (F.col("refers_to") == F.col("_to")) & (F.col("payload_digest") == F.col("_digest")), "left")
    return whole.select("page_id", F.coalesce("payload_bytes", "_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes pages (page_id, url, html) as WARC with an index into the shared checkpoint folder, and reads all of them back through it.

    Null html is an empty payload; a null url has the key '' and no target; a null page_id is
    written and found as such. Repeated rows have a record each. No rows give no rows; other columns are left out.
    """
    spark = pages.sparkSession
    path = shared_folder(spark, "warc")
    write_archives(pages, path)
    if _archives(spark, path).isEmpty():
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    write_index(spark, path)
    captures = look_up(spark, path, pages.select(F.col("url").cast("string").alias("url"), F.col("page_id").cast("long").alias("page_id")))
    return read_captures(spark, path, captures)
