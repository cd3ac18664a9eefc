"""What several operators share: table access, shared storage, fixed-size safety checks, word and fold rules."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than ASCII white space. ``bytes.split()`` cuts at exactly the same characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows above which a table is never broadcast.
BROADCAST_ROWS = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir or the context's checkpoint folder.

    Only a local session, whose executors are in the driver, may do without: it gets a temporary folder. A cluster without
    one is an error, as its executors couldn't see a folder of the driver's.
    """
    found, context = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if context.getCheckpointDir() is None:
        if not found and not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(found or tempfile.mkdtemp(prefix="pairfield-"))
    return found or context.getCheckpointDir()


#: The setting by which an execution's shuffle files go as soon as it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _clearing(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is executed inside go at once, not when the driver collects garbage: none is read again."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage by a reliable checkpoint in the shared folder, so a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    with _clearing(df.sparkSession):
        return df.checkpoint(eager=True)


#: Folders that written() has made within temporary(), the innermost last.
_MADE: list[list[str]] = []


def written(df: DataFrame) -> DataFrame:
    """Like cut(), as a Parquet table in the shared folder: columnar and compressed, for wide rows.

    Within temporary() it goes when that ends. Otherwise it stays under stage-*, as lazy results may still need it;
    whoever owns the folder clears it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/stage-{uuid.uuid4().hex}"
    if _MADE:
        _MADE[-1].append(path)
    with _clearing(spark):
        df.write.parquet(path)
    return spark.read.parquet(path)


def removed(spark: SparkSession, paths: list[str]) -> None:
    """Deletes folders, wherever they are."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def superseded(df: DataFrame) -> None:
    """Deletes the table of written() that df is, once nothing will read it again; an empty one stays for temporary()."""
    removed(df.sparkSession, sorted({path.rpartition("/")[0] for path in df.inputFiles()}))


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables that written() makes inside are deleted at the end: results must have been written elsewhere by then."""
    _MADE.append([])
    try:
        yield
    finally:
        removed(spark, _MADE.pop())


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether df has no more rows than that; reads at most one row beyond."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint only for a table whose row count was checked; otherwise the table as it is."""
    return F.broadcast(df) if small(df, rows) else df


#: A key that has more than one in so many rows is hot; so there are fewer hot keys than that. Below LEAST_HOT rows none is.
HOT_SHARE, LEAST_HOT = 100_000, 1_000


def looked_up(rows: DataFrame, keyed: DataFrame, on: list[str], n: str = "n") -> DataFrame:
    """rows joined with keyed, which has one row per key and in column n how many of rows have the key.

    Hot keys, fewer than HOT_SHARE of them, are broadcast, so none is gathered in one task. keyed is read several times:
    it should be a cut or written table. n is dropped; null keys meet nothing.
    """
    total = keyed.agg(F.sum(n)).first()[0] or 0
    hot = F.col(n) > max(LEAST_HOT, total // HOT_SHARE)
    many, few = F.broadcast(keyed.filter(hot).drop(n)), keyed.filter(~hot).drop(n)
    return rows.join(many, on).unionByName(rows.join(many.select(*on), on, "left_anti").join(few, on))


def fold(doc_id: Column | str, n: int) -> Column:
    """crc32 of doc_id as text, modulo n."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % n


#: Bytes of text in a slice of rows, unless one text is longer.
SLICE_BYTES = 4 << 20


def slices(batch: pa.RecordBatch, column: int, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """A batch in parts of so many rows and, in a binary column, SLICE_BYTES at most; a longer text is a part by itself."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total, at = np.concatenate([[0], np.cumsum(size, dtype=np.int64)]), 0
    while at < batch.num_rows:
        end = max(at + 1, min(at + rows, int(np.searchsorted(total, total[at] + SLICE_BYTES, "right")) - 1))
        yield batch.slice(at, end - at)
        at = end


def per_text(
    df: DataFrame,
    schema: str,
    make: Callable[[], Callable[[list], list[Iterable]]],
    keys: tuple[str, ...] = ("doc_id",),
    text: str = "text",
    slice_rows: int = 512,
) -> DataFrame:
    """One output row per input row: the key columns, then what make()'s function returns as columns for UTF-8 texts.

    make() runs once in each Python worker's task. Rows go through in slices, so memory is bounded by a slice, and
    nothing depends on how rows are dealt to tasks. The texts arrive as bytes or None.
    """
    key_types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    out = ", ".join([*(f"`{k}` {key_types[k]}" for k in keys), schema])
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in slices(batch, len(keys), slice_rows):
                made = work(part.column(len(keys)).to_pylist())
                columns = [part.column(i).cast(target.field(i).type) for i in range(len(keys))]
                columns += [pa.array(x, type=target.field(len(keys) + i).type) for i, x in enumerate(made)]
                yield pa.RecordBatch.from_arrays(columns, schema=target)

    picked = df.select(*[F.col(f"`{k}`") for k in keys], F.col(f"`{text}`").cast("string").cast("binary").alias("__text"))
    return picked.mapInArrow(run, out)


def rows_where(df: DataFrame, make: Callable[[], Callable[[list], list[bool]]], text: str = "text", slice_rows: int = 512) -> DataFrame:
    """The rows of df, with all columns, whose text (UTF-8 bytes or None) make()'s function marks; no shuffle."""
    at = [f.name for f in df.schema.fields].index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = make()
        for batch in batches:
            for part in slices(batch, at, slice_rows):
                yield part.filter(pa.array(keep(part.column(at).cast(pa.binary()).to_pylist()), pa.bool_()))

    return df.mapInArrow(run, df.schema)
