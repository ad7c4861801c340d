"""Files that driver and executors share, and small Arrow helpers.

Everything an operator stores between stages goes below the folder named by
``spark.checkpoint.dir`` as a table of its own (a fresh UUID), so that a lost
executor never loses data and two runs never meet. Only where that setting is
missing (local tests) is a folder of this machine used.
"""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CONF = "spark.checkpoint.dir"
#: Folders, and tables of the session's catalog, that this driver has made and not swept.
_FOLDERS: list[str] = []
_TABLES: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """URI of a new, empty subfolder of the shared folder."""
    base = spark.conf.get(_CONF, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{_CONF} must name a folder that all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "wavelattice-shared")
        spark.conf.set(_CONF, base)
    if "://" not in base and not base.startswith("file:"):
        base = "file://" + base if base.startswith("/") else base
    _FOLDERS.append(f"{base.rstrip('/')}/wl-{uuid.uuid4().hex}")
    return _FOLDERS[-1]


def sweep(spark: SparkSession) -> int:
    """Remove all that operators have stored so far; results that still read it must have been written before. The number of folders."""
    from pyarrow import fs

    n = len(_FOLDERS)
    while _TABLES:
        spark.sql(f"DROP TABLE IF EXISTS {_TABLES.pop()}")
    while _FOLDERS:
        system, path = fs.FileSystem.from_uri(_FOLDERS.pop())
        if system.get_file_info(path).type == fs.FileType.Directory:
            system.delete_dir(path)
    return n


#: Where the shared folder is a mounted one, Hadoop's checksum layer starts a process (``chmod``) twice
#: for every file an executor writes. Parquet needs neither its checksum files nor those modes.
_PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def _writer(df: DataFrame):
    return df.write.option("compression", "zstd").options(**_PLAIN_FILES)


def stored(df: DataFrame, small: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage.

    ``small``: the rows are few beside those of the tables they come from, so
    an eighth of the usual partitions holds them.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    _writer(df.coalesce(max(1, shuffle_parts(spark) // 8)) if small else df).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of rows that a task writes together.
_GROUP = 16 << 20


def stored_map(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``stored(arrow_map(df, function, schema))``, but tasks write what ``function`` makes themselves.

    Rows don't go back through the JVM. A task's file counts once the task has
    succeeded and its name has come back; what failed attempts left is removed.
    """
    spark = df.sparkSession
    root = shared_dir(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        from wavelattice.llm.shared import open_output, tidy

        name, writer, held, size = f"{uuid.uuid4().hex}.parquet", None, [], 0

        def flush() -> None:
            nonlocal writer, held, size
            if writer is None:
                writer = pq.ParquetWriter(open_output(f"{root}/{name}"), held[0].schema, compression="zstd")
            table = pa.Table.from_batches(held)
            writer.write_table(table, row_group_size=max(1, table.num_rows))
            held, size = [], 0

        try:
            for batch in function(batches):
                if batch.num_rows:
                    held.append(batch)
                    size += batch.nbytes
                    if size >= _GROUP:
                        flush()
            if held:
                flush()
            if writer is not None:
                writer.close()
                yield pa.RecordBatch.from_arrays([pa.array([name])], ["name"])
        finally:
            tidy()

    from pyarrow import fs

    names = set(df.mapInArrow(run, "name string").toArrow().column(0).to_pylist())  # a name for each task
    if not names:
        return spark.createDataFrame([], schema)
    system, folder = fs.FileSystem.from_uri(root)
    for info in system.get_file_info(fs.FileSelector(folder)):
        if info.base_name not in names:
            system.delete_file(info.path)
    return spark.read.schema(schema).parquet(root)


def bucketed(df: DataFrame, keys: list[str], dealt: bool = False) -> DataFrame:
    """Like :func:`stored`, dealt into buckets by ``keys`` and sorted in them: later joins on the keys don't move it again.

    ``dealt``: an aggregation or join on the keys has put the rows of a bucket together already.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    n = shuffle_parts(spark)
    name = "wl_" + uuid.uuid4().hex
    rows = df if dealt else df.repartition(n, *keys)
    _TABLES.append(name)
    _writer(rows).option("path", path).bucketBy(n, *keys).sortBy(*keys).saveAsTable(name)
    return spark.table(name)


def fresh_prefix(columns: list[str], prefix: str = "__own") -> str:
    """A prefix that no column's name begins with."""
    while any(c.lower().startswith(prefix) for c in columns):
        prefix += "_"
    return prefix


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just the id (long) and the text (null: empty) of a documents table."""
    return df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )


#: Called when a task ends; modules that keep tables in the worker put their ``clear`` here.
TABLES: list[Callable[[], None]] = []


def tidy() -> None:
    """Drop the worker's tables and give freed memory back: the next task in it may be another stage's."""
    for clear in TABLES:
        clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def arrow_map(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow`` whose tasks leave nothing behind in their worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from wavelattice.llm.shared import tidy

        try:
            yield from function(batches)
        finally:
            tidy()

    return df.mapInArrow(run, schema)


def text_slices(batch: pa.RecordBatch, limit: int = 4 << 20, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of a batch holding about ``limit`` bytes of text each (one row at least)."""
    sizes = batch.column(column)
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.binary_length(sizes), 0).to_pylist()
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if held and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(lengths):
        yield batch.slice(start)


def open_output(uri: str):
    """A binary stream to a new file; its folder is made."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    return system.open_output_stream(path)


def open_input(uri: str):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_stream(path)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def maybe_in(rows: DataFrame, hashed, keys: DataFrame, key_hashed, most_bits: int = 30) -> DataFrame:
    """``rows`` without most of those whose hash no row of ``keys`` has.

    The keys' hashes set bits of a map that is broadcast: sixteen bits for
    each key, 2 ** 20 at least. Where that would be more than
    ``2 ** most_bits`` (128 MiB) the rows are returned as they are. It only
    spares a shuffle: rows that pass by chance are for the join that follows.
    """
    bits = max(20, (16 * keys.count()).bit_length())
    if bits > most_bits:
        return rows
    place = lambda h: F.pmod(h, F.lit(1 << bits)) + 1
    own = fresh_prefix([*rows.columns, *keys.columns])
    p, bucket, held = f"{own}_p", f"{own}_bucket", f"{own}_bits"
    table = (
        keys.select(place(key_hashed).alias(p))
        .groupBy(F.bitmap_bucket_number(p).alias(bucket))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(p)).alias(held))
    )
    marked = rows.withColumn(p, place(hashed)).withColumn(bucket, F.bitmap_bucket_number(p))
    byte = F.conv(F.hex(F.expr(f"substring({held}, cast(bitmap_bit_position({p}) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    hit = byte.bitwiseAND(F.expr(f"shiftleft(1, cast(bitmap_bit_position({p}) % 8 as int))")) != 0
    return marked.join(F.broadcast(table), bucket).filter(hit).drop(p, bucket, held)
