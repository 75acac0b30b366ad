"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Documents whose crc32 of the decimal id leaves this remainder are held out of training.
HELD_OUT_MODULUS = 5
#: Bytes of rows that go to Python at once.
BATCH_BYTES = 8 << 20
#: Rows of a few numbers, and rows with a text's hashes, that a task takes before there are more tasks than cores.
TASK_ROWS, TASK_WIDE_ROWS = 100_000, 2_000


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where neither that setting nor a checkpoint folder exists, a session on a single
    machine gets a local temporary folder; on a cluster that is an error, as executors
    wouldn't see each other's files.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="talewarp-checkpoint-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared root."""
    return f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder and what it holds, on any store that Spark knows."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in a new folder of the shared root; smaller than a checkpoint, and it stays."""
    folder = fresh_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def sized(df: DataFrame, rows: int, each: int = TASK_ROWS) -> DataFrame:
    """``df`` in no more partitions than ``rows`` rows need, or cores; never in more than it has.

    A task that writes to a shuffle leaves three files, one that writes a checkpoint two,
    and both a line in the event log, however few rows they have. The number of shuffle
    partitions is chosen for the whole input; what is derived from it may be far smaller.
    """
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // each)))


def quoted(name: str) -> Column:
    """A column by its whole name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, made longer until ``df`` has no such column in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small_or_not(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows; else left to a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def joined(rows: DataFrame, table: DataFrame, key: str, number: str = "n") -> DataFrame:
    """``rows`` with the columns of ``table``, which has one row a key and each key's number of rows.

    Keys with more than a ten-thousandth of all rows are fewer than ten thousand, so
    they are broadcast; no other key is large enough to hold up a task.
    """
    total = table.agg(F.sum(number)).first()[0] or 0
    heavy = F.col(number) > max(10_000, total // 10_000)
    few, rest = F.broadcast(table.where(heavy).drop(number)), table.where(~heavy).drop(number)
    return rows.join(few, key).unionByName(rows.join(few.select(key), key, "left_anti").join(rest, key))


def held_out(doc_id: Column | str) -> Column:
    """True where crc32 of the id's decimal text is divisible by five."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(col.cast("string").cast("binary")) % HELD_OUT_MODULUS == 0


def by_bytes(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` with at most about ``limit`` bytes of ``column`` each (one row at least)."""
    lengths = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
    start = size = 0
    for row, n in enumerate(lengths):
        if size and size + n > limit:
            yield batch.slice(start, row - start)
            start, size = row, 0
        size += n
    if start < len(lengths):
        yield batch.slice(start)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null becomes empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


_kept: dict[str, object] = {}


def kept(key: str, make: Callable[[], object]) -> object:
    """What a worker holds under ``key`` from task to task; it holds one thing at a time."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def enter(key: str) -> None:
    """Drop what a reused worker holds under another key than ``key``."""
    if key not in _kept:
        _kept.clear()
        leave()


def leave() -> None:
    """Give free memory back to the system, as workers are reused and may wait for long."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # where the C library has it
        trim(0)


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema, keeps: str = "") -> DataFrame:
    """``df.mapInArrow`` in batches of at most about ``BATCH_BYTES``; ``keeps`` names what tasks hold (``kept``).

    Spark's own limit of 64 MB is held by each running task some times over, outside the
    JVM's heap and in Python. The setting is the session's, as Spark reads it when the
    plan is run; one that was made by the user is left as it is.
    """
    conf, name, own = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch", f"{64 << 20}b"
    if conf.get(name, own) == own:
        conf.set(name, f"{BATCH_BYTES}b")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter(keeps)
        yield from run(batches)
        leave()

    return df.mapInArrow(task, schema)


def keep_rows(docs: DataFrame, keep: Callable[[list[str]], Iterable[bool]], slice_bytes: int = 1 << 20, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all columns, for whose texts ``keep`` is true (null: empty).

    One map without a shuffle; rows without an id are judged like any other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, text_col, slice_bytes):
                texts = [t or "" for t in part.column(text_col).to_pylist()]
                yield part.filter(pa.array(list(keep(texts)), pa.bool_()))

    return map_batches(docs, run, docs.schema)
