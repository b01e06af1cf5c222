"""WARC archives with a two-level capture index.

Pages become WARC/1.1 records, each a gzip member of its own, written where they are scanned: one row for a record (key,
file, offset, length) is all that moves. A first scan takes the digests, a second writes. Of pages with equal payloads of at least ``LEAST_REVISIT`` bytes the one with the
largest page_id is stored, the others are revisit records that name it.

The index sorts those rows by reversed-host URL key into compressed blocks of ``BLOCK_LINES`` lines (one file for each
range partition), and keeps a sparse directory with one line for each block. A lookup bisects the list of index files by
their first keys, bisects the file's directory, reads and unpacks one block by its range, bisects the block, and reads
one record by its range.

Files go to a folder that all machines see, through a file system opened by its address. A task writes under a name of
its own attempt and then renames, so a repeated task replaces equal content. Only one row per index file reaches the driver.
Reading back is dealt to as many tasks as the archives' bytes ask for. The query deletes its archives when they are read.

Defined results: null html is an empty payload; a null url has an empty key part. A key ends with the payload's digest, so
rows of one page_id and url with different html are captures of their own, each found as such; fully equal rows have equal
records and any of them is found. A null page_id is stored under a mark of its own, and is a revisit if a named page has its
payload. Other columns, under any name, are ignored. An empty table gives empty archives and an empty result.
"""

from __future__ import annotations

import base64
import bisect
import collections
import gzip
import hashlib
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Sealed, cut, remove, shared_folder, table

LEAST_REVISIT = 1000
BLOCK_LINES = 500
FILE_BYTES = 1 << 30
#: Index lines of a file, and archive bytes that one task reads back.
FILE_LINES, READ_BYTES = 250_000, 32 << 20
#: Payload digests that are shared go to all executors up to this many, else they are joined by a shuffle.
BROADCAST_DIGESTS = 1_000_000
#: A fixed date, so that reruns give equal archives.
DATE = "2020-01-01T00:00:00Z"


def key_of(url: Column, page_id: Column, digest: Column | None = None) -> Column:
    """Host labels from last to first, the rest of the url, and the page's number; then the payload's digest, without which the key stands for all captures that have it."""
    whole = F.coalesce(url, F.lit(""))
    host = F.lower(F.regexp_extract(whole, "(?s)^.*?://([^/?#]*)", 1))
    rest = F.regexp_extract(whole, "(?s)^.*?://[^/?#]*(.*)$", 1)
    number = F.coalesce(F.lpad(page_id.cast("string"), 20, "0"), F.lit("-" * 20))
    parts = [F.array_join(F.reverse(F.split(host, "\\.")), ","), F.lit(")"), rest, F.lit(" "), number]
    return F.regexp_replace(F.concat(*parts, *([F.lit(" "), digest] if digest is not None else [])), "[\\t\\r\\n]", "%0A")


def _store(root: str):
    return pyarrow.fs.FileSystem.from_uri(root if "://" in root else f"file://{root}" if root.startswith("/") else root.replace("file:/", "file:///", 1))


class _Out:
    """Files of one task: written under an attempt's name, renamed when whole."""

    def __init__(self, root: str, kind: str):
        self.fs, self.root = _store(root)
        task = TaskContext.get()
        self.part, self.attempt, self.kind, self.count = task.partitionId(), task.taskAttemptId(), kind, 0
        self.open()

    def open(self) -> None:
        self.name = f"{self.kind}-{self.part:06d}-{self.count:04d}"
        self.fs.create_dir(self.root, recursive=True)
        self.stream, self.at = self.fs.open_output_stream(f"{self.root}/.{self.name}.{self.attempt}", compression=None), 0
        self.count += 1

    def write(self, data: bytes) -> tuple[str, int, int]:
        place = self.name, self.at, len(data)
        self.stream.write(data)
        self.at += len(data)
        return place

    def close(self) -> None:
        self.stream.close()
        self.fs.move(f"{self.root}/.{self.name}.{self.attempt}", f"{self.root}/{self.name}")


def record(page_id, url: str | None, payload: bytes, digest: str, refers_key: str | None, refers_to) -> bytes:
    """One gzip member: a response with its payload, or a revisit without. ``digest``: the payload's SHA-1 in hex."""
    digest = base64.b32encode(bytes.fromhex(digest)).decode()
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page_id}")
    head = {"WARC-Type": "revisit" if refers_key else "response", "WARC-Record-ID": f"<urn:uuid:{name}>", "WARC-Target-URI": " ".join((url or "about:blank").split()), "WARC-Date": DATE, "WARC-Payload-Digest": f"sha1:{digest}", "Content-Type": "application/http; msgtype=response", "WARC-Page": str(page_id)}
    if refers_key:
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}')}>", "WARC-Refers-To-Page": str(refers_to), "WARC-Refers-To-Key": base64.b64encode(refers_key.encode()).decode()}
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_key else http + payload
    lines = "".join(f"{k}: {v}\r\n" for k, v in (head | {"Content-Length": len(body)}).items())
    return gzip.compress(f"WARC/1.1\r\n{lines}\r\n".encode() + body + b"\r\n\r\n", compresslevel=3, mtime=0)


def parsed(member: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of a record."""
    head, _, rest = zlib.decompress(member, 31).partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines)
    return fields, rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")[2]


def _archived(root: str):
    def run(batches):
        out = None
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                out = out or _Out(root, "warc")
                if out.at >= FILE_BYTES:
                    out.close()
                    out.open()
                rows.append((r["key"], *out.write(record(r["page_id"], r["url"], (r["html"] or "").encode(), r["digest"], r["refers_key"], r["refers_to"]))))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["key", "file", "offset", "length"])
        if out:
            out.close()

    return run


def _indexed(root: str):
    def run(batches):
        out, lines, directory, last, total = None, [], [], "", 0

        def block() -> None:
            _, at, size = out.write(zlib.compress("\n".join(lines).encode(), 6))
            directory.append(f"{lines[0].split(chr(9), 1)[0]}\t{at}\t{size}")
            lines.clear()

        for batch in batches:
            for r in batch.to_pylist():
                out = out or _Out(root, "index")
                lines.append(f"{r['key']}\t{r['file']}\t{r['offset']}\t{r['length']}")
                last, total = r["key"], total + r["length"]
                if len(lines) >= BLOCK_LINES:
                    block()
        if out:
            if lines:
                block()
            at = out.at
            out.write(zlib.compress("\n".join(directory).encode(), 6))
            out.close()
            columns = [[directory[0].split("\t", 1)[0]], [last], [out.name], [at], [out.at - at], [total]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["first", "last", "file", "at", "size", "held"])

    return run


class CaptureIndex:
    """Lookups by key in the archives of a folder; ``files`` has a tuple (first key, last key, file, at, size, bytes of its records) for each index file."""

    def __init__(self, root: str, files: list[tuple]):
        self.fs, self.root = _store(root)
        self.files = sorted(files)
        self.lasts = [f[1] for f in self.files]
        self.open_files, self.directories, self.blocks = (collections.OrderedDict() for _ in range(3))

    def _kept(self, cache: collections.OrderedDict, key, most: int, make):
        if key in cache:
            cache.move_to_end(key)
        else:
            cache[key] = make()
            if len(cache) > most:
                cache.popitem(last=False)
        return cache[key]

    def read(self, file: str, at: int, size: int) -> bytes:
        return self._kept(self.open_files, file, 64, lambda: self.fs.open_input_file(f"{self.root}/{file}")).read_at(size, at)

    def _block(self, i: int, k: int) -> tuple[list[str], list[list[str]]]:
        """Keys and lines of a block of a file; none past the last."""
        _, _, file, at, size, _ = self.files[i]
        rows = lambda data: [x.split("\t") for x in zlib.decompress(data).decode().split("\n")]
        firsts, places = self._kept(self.directories, file, 16, lambda: (lambda d: ([x[0] for x in d], [(int(x[1]), int(x[2])) for x in d]))(rows(self.read(file, at, size))))
        if k >= len(firsts):
            return [], []
        return self._kept(self.blocks, (file, k), 8, lambda: (lambda b: ([x[0] for x in b], b))(rows(self.read(file, *places[k]))))

    def find(self, key: str) -> tuple[str, int, int] | None:
        """File, offset and length of the first record whose key is this one, or this one with a digest."""
        i = bisect.bisect_left(self.lasts, key)
        if i == len(self.files):
            return None
        self._block(i, 0)
        firsts = self.directories[self.files[i][2]][0]
        k = max(0, bisect.bisect_right(firsts, key) - 1)
        keys, lines = self._block(i, k)
        j = bisect.bisect_left(keys, key)
        if j == len(keys):  # the next block begins with what follows
            (keys, lines), j = self._block(i, k + 1), 0
        return (lines[j][1], int(lines[j][2]), int(lines[j][3])) if j < len(keys) and (keys[j] == key or keys[j].startswith(f"{key} ")) else None

    def record(self, key: str) -> tuple[dict[str, str], bytes] | None:
        place = self.find(key)
        return parsed(self.read(*place)) if place else None


def _read_back(root: str, files: list[tuple]):
    def run(batches):
        index, payloads = CaptureIndex(root, files), collections.OrderedDict()

        def full(key: str) -> tuple[int, str]:
            _, payload = index.record(key)
            return len(payload), hashlib.sha1(payload).hexdigest()

        for batch in batches:
            rows = []
            for page, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fields, payload = index.record(key)
                if fields["WARC-Type"] == "revisit":
                    other = base64.b64decode(fields["WARC-Refers-To-Key"]).decode()
                    rows.append((page, *index._kept(payloads, other, 4096, lambda: full(other)), "revisit", int(fields["WARC-Refers-To-Page"])))  # noqa: B023
                else:
                    rows.append((page, len(payload), hashlib.sha1(payload).hexdigest(), "response", None))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return run


def captures(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, digest, key) of ``pages``."""
    sealed = Sealed(pages)
    page, url, html = sealed.of("page_id").cast("long"), sealed.of("url", "string"), sealed.of("html", "string")
    digest = F.sha1(F.coalesce(html, F.lit("")))
    found = sealed.df.select(page.alias("page_id"), url.alias("url"), html.alias("html"), digest.alias("digest"))
    return found.withColumn("key", key_of(F.col("url"), F.col("page_id"), F.col("digest")))


def write_archives(pages: DataFrame, root: str, named: DataFrame | None = None) -> list[tuple]:
    """Writes archives and index of ``pages`` (page_id, url, html) below ``root``; gives what ``CaptureIndex`` needs.

    ``named``: what ``names`` gives of the pages, if it is there already.
    """
    named = names(pages) if named is None else named
    big = named.filter(F.col("size") >= LEAST_REVISIT)
    last = big.filter("page_id is not null").groupBy("digest").agg(F.max(F.struct("page_id", "key")).alias("last"))
    shared = cut(big.groupBy("digest").count().filter("count > 1").join(last, "digest").select("digest", F.col("last.page_id").alias("refers_to"), F.col("last.key").alias("refers_key")))
    few = shared.count() <= BROADCAST_DIGESTS
    joined = captures(pages).join(F.broadcast(shared) if few else shared, "digest", "left")
    other = F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    typed = joined.select("page_id", "url", "html", "digest", "key", F.when(other, F.col("refers_to")).alias("refers_to"), F.when(other, F.col("refers_key")).alias("refers_key"))
    rows = cut(typed.mapInArrow(_archived(root), "key string, file string, offset long, length long"))
    dealt = rows.repartitionByRange(max(1, -(-rows.count() // FILE_LINES)), "key", "file", "offset").sortWithinPartitions("key", "file", "offset")
    files = dealt.mapInArrow(_indexed(root), "first string, last string, file string, at long, size long, held long")
    return [(r["first"], r["last"], r["file"], r["at"], r["size"], r["held"]) for r in files.collect()]


def names(pages: DataFrame) -> DataFrame:
    """(page_id, key, digest, size) of ``pages``, cut."""
    return cut(captures(pages).select("page_id", "key", "digest", F.octet_length(F.coalesce("html", F.lit(""))).alias("size")))


def read_back(named: DataFrame, root: str, files: list[tuple]) -> DataFrame:
    """Each of the captures ``named`` (page_id, key) as the archives have it, looked up in the order of keys."""
    tasks = max(named.sparkSession.sparkContext.defaultParallelism, -(-sum(f[5] for f in files) // READ_BYTES))
    dealt = named.select("page_id", "key").repartitionByRange(tasks, "key", "page_id").sortWithinPartitions("key")
    return dealt.mapInArrow(_read_back(root, files), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def read_archives(pages: DataFrame, root: str, files: list[tuple]) -> DataFrame:
    """Each of ``pages`` (page_id, url, html) as the archives have it."""
    return read_back(names(pages), root, files)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    named = names(pages)
    out = cut(read_back(named, root, write_archives(pages, root, named)))
    remove(spark, root)
    return out
