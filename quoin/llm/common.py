"""Plumbing shared by the training-data operators."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that ends a word: 0x20 and 0x09 to 0x0D. ``bytes.split()`` cuts at exactly these.
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Files that ``placed`` writes at most; Spark allows 100,000 buckets a table.
MOST_FILES = 50_000
#: Bits in one piece of a bitmap (fixed by Spark's bitmap functions).
BITS = 1 << 15
_OPEN: list[list[tuple[SparkSession, str, str | None]]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``. Where none is set, a local master gets a temporary one, and
    a cluster an error, since no folder of one machine would do."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="quoin-")
        spark.sparkContext.setCheckpointDir(base)
    return base


def fresh_path(spark: SparkSession, label: str, name: str | None = None) -> str:
    """A path in the shared folder that nothing has used; inside ``scratch`` it is deleted at the end."""
    path = f"{shared_dir(spark)}/quoin/{label}-{uuid.uuid4().hex}"
    if _OPEN:
        _OPEN[-1].append((spark, path, name))
    return path


def delete(spark: SparkSession, path: str, name: str | None = None) -> None:
    """Removes a folder, and the catalog's entry of the table in it if it has one."""
    if name:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    jvm = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(jvm, True)


@contextmanager
def scratch() -> Iterator[None]:
    """Deletes on leaving what operators have written inside. Results that are still to be read must be written before."""
    _OPEN.append([])
    try:
        yield
    finally:
        for spark, path, name in _OPEN.pop():
            delete(spark, path, name)


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and any executor may be lost."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 8 MB at most, unless the session asks for other than Spark's 64 MB: a worker and the JVM each hold
    a few batches, and texts may be long."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key).lower() in ("67108864b", "67108864", "64m", "64mb"):
        spark.conf.set(key, "8m")


def id_and_text(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The two columns that text operators read, so that others are pruned and their names cannot clash; and ``keep``."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *keep)


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as empty text (remainder 0)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def _bucket_numbers(spark: SparkSession, n: int) -> list[int]:
    """For each of ``n`` buckets a number that Spark's bucketing puts there."""
    bucket = F.pmod(F.hash(F.col("id").cast("int")), F.lit(n))
    found = spark.range(0, n * (int(math.log(n)) + 24), 1, 4).groupBy(bucket.alias("b")).agg(F.min("id").alias("x")).collect()
    numbers = {r.b: r.x for r in found}
    return [numbers[b] for b in range(n)]


def placed(docs: DataFrame, label: str = "rows") -> DataFrame:
    """``docs`` with ``__file`` and ``__at``, written once: every row has a place that stays, whatever its ids are.

    A task writes its rows to one bucket of a bucketed table, whose number it is given, so nothing is shuffled; and later
    joins on ``__file`` find this side where it has to be. Rows of one file are at most those of one input split.
    """
    spark = docs.sparkSession
    if docs.rdd.getNumPartitions() > MOST_FILES:
        docs = docs.coalesce(MOST_FILES)
    n = max(1, docs.rdd.getNumPartitions())
    numbers = F.split(F.lit(",".join(map(str, _bucket_numbers(spark, n)))), ",").cast("array<int>")
    rows = docs.withColumn("__file", F.get(numbers, F.pmod(F.spark_partition_id(), F.lit(n)))).withColumn("__at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    name = f"quoin_{uuid.uuid4().hex}"
    path = fresh_path(spark, label, name)
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key)
    spark.conf.set(key, "2")  # a task has one bucket: its rows needn't be sorted first
    try:
        rows.write.bucketBy(n, "__file").option("path", path).format("parquet").saveAsTable(name)
    finally:
        spark.conf.set(key, before)
    return spark.table(name)


def bitmaps(marks: DataFrame) -> DataFrame:
    """__file, __marks: the numbers ``__mark`` of each file as pieces of a bitmap. A file has as many bits as numbers, so a
    row here is bounded by the file, however many rows carry marks."""
    at = F.col("__mark") + 1
    pieces = marks.groupBy("__file", F.floor(F.col("__mark") / BITS).cast("int").alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    return pieces.groupBy("__file").agg(F.map_from_entries(F.collect_list(F.struct("piece", "bits"))).alias("__marks"))


def marked(marks: Column, number: Column) -> Column:
    """Whether a number is in bitmaps as above (null bitmaps hold none)."""
    bits = F.element_at(marks, F.floor(number / BITS).cast("int"))
    byte = F.conv(F.hex(F.substring(bits, F.floor(F.pmod(number, F.lit(BITS)) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, F.pmod(number, F.lit(8)).cast("int")) == 1, F.lit(False))


def written_marks(marks: DataFrame) -> DataFrame:
    """The bitmaps of ``marks``, written where ``scratch`` around this call doesn't delete them (one further out does)."""
    own = _OPEN.pop() if _OPEN else None
    try:
        return cut(bitmaps(marks), "marks")
    finally:
        if own is not None:
            _OPEN.append(own)


def with_marks(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """``rows`` (from ``placed``) with the bitmaps of their files. Only the bitmaps move."""
    return rows.join(marks.hint("shuffle_hash"), "__file", "left")


def without(rows: DataFrame, gone: Callable[[], DataFrame]) -> DataFrame:
    """``rows`` (from ``placed``) but for those at the places ``__file, __at`` of ``gone()``; the two columns go. What is
    written to find the places is deleted when they are known."""
    with scratch():
        marks = written_marks(gone().select("__file", F.col("__at").alias("__mark")))
    kept = with_marks(rows, marks)
    return kept.where(~marked(F.col("__marks"), F.col("__at"))).drop("__file", "__at", "__marks")
