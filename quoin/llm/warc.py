"""WARC archives of pages, and a globally ordered index of their captures.

Writing: each page becomes one WARC/1.1 record. Of pages with equal payloads of at least ``MIN_REVISIT`` bytes the one
with the smallest id is stored as a response, the others as revisits that refer to it. Records end in two CRLF, which is
the line separator given to Spark's text writer, so archives go wherever Spark can write. A task begins a new archive, in a
folder of its own number, when ``BYTES_PER_FILE`` are written, so an archive is at most that and one record.

Reading: every archive is parsed by its Content-Length headers, digests are taken again from what was read, and the
archive's captures are sorted by URL key and time: a run. External merge: the key space is cut into ranges of bounded
size, and in each range a loser tree merges the runs, which stay in Arrow and are read as streams; ranges follow one
another, so the whole index is in order. A history numbers the captures of a key. Where a key goes on in the next ranges,
counts of the keys at range edges carry its number over, so a key with a third of all captures needs no task of its own.

Scale: digests are grouped with partial sums, so many copies of one page cost a row a task; the join back streams pages
and Spark splits it if it is skewed. A task holds one archive, or one range of index rows.

Edge cases: null html is an empty payload; a null url has an empty key; CR and LF in urls are escaped; page ids that
repeat give a record each, and those equal to the smallest id are all responses. A null page_id is written as empty and
read back as null, and never is the one referred to. Pages without a time of capture (column ``captured_at``, or null)
get ``date``. A record whose payload doesn't have its digest is an error of ``archive``.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh_path, small_batches

MIN_REVISIT = 100
BYTES_PER_FILE = 64 << 20
ROWS_PER_RANGE = 100_000
DATE = "2024-01-01T00:00:00Z"
_END = "\r\n\r\n"
CAPTURE = "page_id long, record_type string, url string, url_key string, captured_at string, payload_bytes long, payload_digest string, refers_to long, offset long, length long, intact boolean"


def url_key(url: str | None) -> str:
    """A sortable form of a url: reversed host without www and port, then path and query; scheme and fragment go."""
    try:
        parts = urlsplit((url or "").strip())
        host = (parts.hostname or "").removeprefix("www.")
    except ValueError:
        return (url or "").lower()
    if not host:
        return (url or "").lower()
    path = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return ",".join(reversed(host.split("."))) + ")" + path.lower()


def with_types(pages: DataFrame, min_revisit: int = MIN_REVISIT, date: str = DATE) -> DataFrame:
    """page_id, url, html, captured_at with payload_bytes, payload_digest, record_type and refers_to."""
    at = F.coalesce(F.date_format(F.col("captured_at").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(date)) if "captured_at" in pages.columns else F.lit(date)
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), at.alias("captured_at"))
    own = own.withColumn("payload_bytes", F.octet_length("html").cast("long")).withColumn("payload_digest", F.sha2("html", 256))
    firsts = own.where(F.col("payload_bytes") >= min_revisit).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null")
    joined = own.join(cut(firsts.select("payload_digest", "first"), "copied"), "payload_digest", "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "html", "captured_at", "payload_bytes", "payload_digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to"))


def write(pages: DataFrame, path: str, date: str = DATE, min_revisit: int = MIN_REVISIT, bytes_per_file: int = BYTES_PER_FILE) -> None:
    """Archives of ``pages`` in the folder ``path``."""
    typed = with_types(pages, min_revisit, date)
    revisit = F.col("record_type") == "revisit"
    block = F.when(revisit, F.lit("")).otherwise(F.col("html"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    lines = [
        F.concat(F.lit("WARC/1.1\r\nWARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), text("page_id"), F.lit(">")),
        F.concat(F.lit("WARC-Date: "), F.col("captured_at")),
        F.when(F.col("url").isNotNull(), F.concat(F.lit("WARC-Target-URI: "), F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")))),
        F.when(revisit, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"), text("refers_to"), F.lit(">\r\nX-Payload-Length: "), text("payload_bytes"))),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("payload_digest")),
        F.concat(F.lit("Content-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(block).cast("string")),
    ]
    record = F.concat(F.concat_ws("\r\n", *lines), F.lit(_END), block)

    @F.arrow_udf("int")
    def archive_number(sizes: Iterator[pa.Array]) -> Iterator[pa.Array]:
        number, held = 0, 0  # a task's records come in order, in one iterator
        for batch in sizes:
            out = []
            for n in batch.to_pylist():
                if held >= bytes_per_file:
                    number, held = number + 1, 0
                held += n
                out.append(number)
            yield pa.array(out, pa.int32())

    (
        typed.select(record.alias("value")).select("value", archive_number(F.octet_length("value")).alias("archive")).write.partitionBy("archive")
        .option("lineSep", _END).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)
    )


def parse(data: bytes) -> Iterator[tuple]:
    """The captures of one archive, in its order; rows as in CAPTURE."""
    at, size = 0, len(data)
    while at < size:
        body = data.index(b"\r\n\r\n", at) + 4
        head = data[at : body - 4].decode().split("\r\n")
        if head[0] != "WARC/1.1":
            raise ValueError(f"no record at byte {at}")
        fields = dict(line.split(": ", 1) for line in head[1:])
        length = int(fields["Content-Length"])
        end = body + length
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} doesn't end where it should")
        told = fields["WARC-Payload-Digest"].removeprefix("sha256:")
        number = lambda x: int(x) if (x := x.removeprefix("<urn:page:").removesuffix(">")) else None
        if fields["WARC-Type"] == "revisit":
            n, digest, refers = int(fields["X-Payload-Length"]), told, number(fields["WARC-Refers-To"])
        else:
            n, digest, refers = length, hashlib.sha256(memoryview(data)[body:end]).hexdigest(), None
        url = fields.get("WARC-Target-URI")
        yield number(fields["WARC-Record-ID"]), fields["WARC-Type"], url, url_key(url), fields["WARC-Date"], n, digest, refers, at, end + 4 - at, digest == told
        at = end + 4


def _order(row: tuple) -> tuple:
    return row[3], row[4], row[0] is None, row[0] or 0, row[8]


def runs(spark, path: str) -> DataFrame:
    """CAPTURE rows of every archive in ``path``, with the archive (``run``) and the place in its sorted run (``pos``)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                rows = sorted(parse(zlib.decompress(content.as_buffer(), 47)), key=_order)
                if rows:
                    cols = [pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)]
                    yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(rows)), pa.array(range(len(rows)), pa.int64()), *cols], names=["run", "pos", *_NAMES])

    small_batches(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", True).load(path).select("path", "content")
    return files.mapInArrow(read, f"run string, pos long, {CAPTURE}")


_NAMES = [x.split()[0] for x in CAPTURE.split(", ")]
_TYPES = [{"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[x.split()[1]] for x in CAPTURE.split(", ")]


class LoserTree:
    """Merges sorted iterators: each inner node keeps the loser of its match, so one new row replays one path."""

    def __init__(self, sources: list[Iterator[tuple]], key) -> None:
        self.sources, self.key, self.k = sources, key, len(sources)
        self.heads: list[tuple | None] = []
        self.keys: list[tuple] = []
        for s in sources:
            row = next(s, None)
            self.heads.append(row)
            self.keys.append((row is None, key(row) if row is not None else ()))
        self.losers = [-1] * max(1, self.k)
        self.winner = -1
        for i in range(self.k):
            self._play(i)

    def _play(self, i: int) -> None:
        node = (i + self.k) // 2
        while node > 0:
            other = self.losers[node]
            if other == -1:  # the first to come waits for the other side
                self.losers[node] = i
                return
            if (self.keys[other], other) < (self.keys[i], i):
                self.losers[node], i = i, other
            node //= 2
        self.winner = i

    def __iter__(self) -> Iterator[tuple]:
        while self.k and self.heads[self.winner] is not None:
            i = self.winner
            yield self.heads[i]
            row = next(self.sources[i], None)
            self.heads[i] = row
            self.keys[i] = (row is None, self.key(row) if row is not None else ())
            self._play(i)


def merged(sorted_runs: DataFrame, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """CAPTURE rows in global order of URL key and time, with ``range`` and ``place`` in it, which give this order, and
    ``history``, the number of the capture among those of its key."""
    ranges = max(1, -(-sorted_runs.count() // rows_per_range))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[str, list[pa.RecordBatch]] = {}
        for batch in batches:
            runs = batch.column(0).to_pylist()
            starts = [i for i, run in enumerate(runs) if not i or run != runs[i - 1]]
            for a, b in zip(starts, [*starts[1:], len(runs)]):
                parts.setdefault(runs[a], []).append(batch.slice(a, b - a))
        number, place, last, n = TaskContext.get().partitionId(), 0, None, 0
        rows: list[tuple] = []
        for row in LoserTree([_stream(x) for x in parts.values()], _order):
            n = n + 1 if row[3] == last else 1
            last = row[3]
            rows.append((number, place, n, *row))
            place += 1
            if len(rows) >= 8192:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)

    dealt = sorted_runs.repartitionByRange(ranges, "url_key", "captured_at", "page_id").sortWithinPartitions("run", "pos")
    out = cut(dealt.select("run", *_NAMES).mapInArrow(merge, f"range int, place long, history long, {CAPTURE}"), "index")
    # keys that go on in a later range are the last of one range and the first of another: at most one a range
    edges = out.groupBy("range").agg(F.min("url_key").alias("first"), F.max("url_key").alias("last"))
    on = edges.select(F.col("first").alias("url_key")).intersect(edges.select(F.col("last").alias("url_key")))
    own = out.join(on, "url_key", "left_semi").groupBy("url_key", "range").agg(F.count(F.lit(1)).alias("n"))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("url_key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = cut(own.select("url_key", "range", earlier.alias("before")).where("before > 0"), "edges")
    return out.join(before, ["url_key", "range"], "left").withColumn("history", F.col("history") + F.coalesce("before", F.lit(0))).select("range", "place", "history", *_NAMES)


def _stream(batches: list[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of a run, without its name, some at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, 64).columns[1:]))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int32(), pa.int64(), pa.int64(), *_TYPES])], names=["range", "place", "history", *_NAMES])


def archive(pages: DataFrame, path: str | None = None, rows_per_range: int = ROWS_PER_RANGE, **options) -> DataFrame:
    """Write ``pages`` to archives, read them back and return the merged index, as ``merged`` does; a payload that isn't
    what its digest says is an error."""
    spark = pages.sparkSession
    path = path or fresh_path(spark, "warc")
    write(pages, path, **options)
    index = merged(cut(runs(spark, path), "capture-runs"), rows_per_range)
    broken = F.raise_error(F.concat(F.lit("payload and digest differ at byte "), F.col("offset").cast("string"))).cast("string")
    return index.withColumn("payload_digest", F.when(F.col("intact"), F.col("payload_digest")).otherwise(broken))
