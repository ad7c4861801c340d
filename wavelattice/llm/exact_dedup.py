"""Exact deduplication over an extendible-hash index kept in shared files.

The 64-bit hash of a text addresses a directory by its leading bits. One
aggregation counts rows and bytes under each prefix; buckets over capacity
split, and the directory doubles whenever a bucket splits that already uses
all its bits. The directory is at most ``2 ** max_depth`` numbers whatever the
corpus holds; buckets that are still overfull at that depth simply are larger
(their rows stream through the owner in hash order).

Map tasks combine equal texts batch by batch, so a group that holds a third
of all rows reaches its owner as one row a batch. Owner tasks take whole
buckets in hash order, chain different texts under one hash, compare bytes,
and append (hash, chain, digest, members) to the index files. Members meet
their group in a plain sort-merge join, which adaptive execution can split
where one group is hot.

Defined results: a null text counts as empty, and empty texts form a group
like any other; a null doc_id ranks below all others (so does the id -2^63,
which comes back null); of rows repeated with
the same doc_id and text exactly one is kept; an empty table gives no rows;
other columns are ignored by :func:`exact_dedup` and passed on by
:func:`drop_duplicates`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import arrow_map, fresh_prefix, id_text, shuffle_parts, stored_map, text_slices

LOWEST = -(2**63)


def build_directory(
    rows: np.ndarray, size: np.ndarray, capacity_rows: int, capacity_bytes: int
) -> tuple[int, np.ndarray, np.ndarray]:
    """(global depth, bucket of each directory slot, local depth of each bucket).

    ``rows`` and ``size`` hold the counts under every prefix of the greatest
    depth, so their length is a power of two.
    """
    finest = len(rows).bit_length() - 1
    sums = [np.concatenate([[0], np.cumsum(x)]) for x in (rows, size)]
    depth, slots = 0, [0]
    local, start = [0], [0]
    todo = [0]
    while todo:
        b = todo.pop()
        width = 1 << (finest - local[b])
        lo, hi = start[b], start[b] + width
        full = sums[0][hi] - sums[0][lo] > capacity_rows or sums[1][hi] - sums[1][lo] > capacity_bytes
        if not full or local[b] == finest:
            continue
        if local[b] == depth:  # double the directory
            slots = [s for s in slots for _ in (0, 1)]
            depth += 1
        local[b] += 1
        new = len(local)
        local.append(local[b])
        start.append(lo + width // 2)
        span = 1 << (depth - local[b])
        first = start[new] >> (finest - depth)
        slots[first : first + span] = [new] * span
        todo += [b, new]
    return depth, np.asarray(slots, dtype=np.int64), np.asarray(local, dtype=np.int64)


def _hashes(texts: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(t) for t in texts.cast(pa.binary()).to_pylist()), np.uint64, len(texts))


def _prefix_counts(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
        for batch in batches:
            texts = batch.column(0)
            at = (_hashes(texts) >> np.uint64(64 - bits)).astype(np.int64)
            rows += np.bincount(at, minlength=1 << bits)
            size += np.bincount(at, pc.binary_length(texts).to_numpy(False), minlength=1 << bits).astype(np.int64)
        full = np.nonzero(rows)[0]
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(rows[full]), pa.array(size[full])], ["prefix", "n", "size"])

    return run


def _combine(depth: int, slots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole):
                table = pa.table({"text": batch.column("text"), "doc_id": batch.column("doc_id")})
                groups = table.group_by("text").aggregate([("doc_id", "list")])
                texts = groups.column("text").combine_chunks()
                if isinstance(texts, pa.ChunkedArray):
                    texts = pa.concat_arrays(texts.chunks)
                h = _hashes(texts)
                slot = (h >> np.uint64(64 - depth)).astype(np.int64) if depth else np.zeros(len(h), np.int64)
                ids = groups.column("doc_id_list").combine_chunks()
                if isinstance(ids, pa.ChunkedArray):
                    ids = pa.concat_arrays(ids.chunks)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(slots[slot]), pa.array(h.view(np.int64)), texts, ids], ["bucket", "h", "text", "ids"]
                )

    return run


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order of (bucket, hash): only the chain of one hash is held."""
    from pyspark import TaskContext

    uid = TaskContext.get().partitionId() << 40
    at, chain = None, []
    for batch in batches:
        chains, digests, uids = [], [], []
        for b, h, text in zip(batch.column("bucket").to_pylist(), batch.column("h").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
            if at != (b, h):
                at, chain = (b, h), []
            for k, (known, digest) in enumerate(chain):
                if known == text:
                    break
            else:
                k, digest = len(chain), hashlib.sha256(text).hexdigest()
                chain.append((text, digest))
            chains.append(k)
            digests.append(digest)
            uids.append(uid)
            uid += 1
        yield pa.RecordBatch.from_arrays(
            [batch.column("bucket"), batch.column("h"), pa.array(chains, pa.int32()), pa.array(digests, pa.string()), pa.array(uids, pa.int64()), batch.column("ids")],
            ["bucket", "h", "chain", "text_sha256", "uid", "ids"],
        )


def directory(docs: DataFrame, capacity_rows: int = 256, capacity_bytes: int = 1 << 20, max_depth: int = 18, first_depth: int = 14) -> tuple[int, np.ndarray]:
    """(depth, bucket of each slot) for the column ``text``: one aggregation, ``2 ** first_depth`` rows to the driver at most."""
    rows = arrow_map(docs.select("text"), _prefix_counts(first_depth), "prefix long, n long, size long")
    found = rows.groupBy("prefix").agg(F.sum("n").alias("n"), F.sum("size").alias("size")).toArrow()
    bits = first_depth
    n, size = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
    at = found.column("prefix").to_numpy()
    n[at], size[at] = found.column("n").to_numpy(), found.column("size").to_numpy()
    extra = max_depth - bits
    mean = size.sum() / len(size)
    grow = int(min(extra, max(0, np.ceil(np.log2(max(1.0, mean / capacity_bytes))) + 1))) if mean > capacity_bytes else 0
    if grow:  # below the counted prefixes hashes are uniform: share the counts out
        n, size = (np.repeat(-(-x // (1 << grow)), 1 << grow) for x in (n, size))
    depth, slots, _ = build_directory(n, size, capacity_rows, capacity_bytes)
    return depth, slots


def _dealt(rows: DataFrame, function, schema) -> DataFrame:
    """Rows with their bucket and hash, bucket by bucket in order of hash."""
    return arrow_map(rows, function, schema).repartition(shuffle_parts(rows.sparkSession), "bucket").sortWithinPartitions("bucket", "h")


def build_index(docs: DataFrame, **options) -> DataFrame:
    """The index files: a row for each batch's share of a group of equal texts."""
    depth, slots = directory(docs, **options)
    dealt = _dealt(docs, _combine(depth, slots), "bucket long, h long, text string, ids array<long>")
    return stored_map(dealt, _own, "bucket long, h long, chain int, text_sha256 string, uid long, ids array<long>")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **index_options) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    index = build_index(id_text(docs, id_col, text_col), **index_options)
    low = F.lit(LOWEST)
    of_row = index.withColumn("best", F.coalesce(F.array_max("ids"), low))
    groups = of_row.groupBy("h", "chain").agg(
        F.max(F.struct("best", "uid")).alias("keep"), F.sum(F.size("ids")).alias("group_size")
    )
    members = of_row.select("h", "chain", "uid", "text_sha256", "best", "ids")
    joined = members.join(groups, ["h", "chain"])
    out = joined.select("uid", "text_sha256", "keep", "group_size", "ids", F.posexplode("ids").alias("at", "doc_id"))
    first = F.col("at") == F.coalesce(F.array_position("ids", F.col("keep.best")) - 1, F.lit(-1))
    null_keep = (F.col("keep.best") == low) & (F.col("at") == 0)
    return out.select(
        "doc_id",
        F.nullif(F.col("keep.best"), low).alias("keep_id"),
        "group_size",
        ((F.col("uid") == F.col("keep.uid")) & (first & (F.col("keep.best") != low) | null_keep)).alias("kept"),
        "text_sha256",
    )


def _best_rows(depth: int, slots: np.ndarray):
    """Of a batch's equal texts the row that ranks first (largest id, nulls last), with its bucket and hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, column="key"):
                texts = batch.column("key").dictionary_encode()
                ids = pc.fill_null(pc.cast(batch.column("id"), pa.int64()), LOWEST).to_numpy(False)
                group = texts.indices.to_numpy(False)
                order = np.lexsort((-np.arange(len(ids)), ids, group))
                last = np.concatenate([group[order][1:] != group[order][:-1], [True]])
                best = order[last]  # in order of the dictionary
                h = _hashes(texts.dictionary)
                slot = (h >> np.uint64(64 - depth)).astype(np.int64) if depth else np.zeros(len(h), np.int64)
                kept = batch.take(pa.array(best))
                yield pa.RecordBatch.from_arrays([pa.array(slots[slot]), pa.array(h.view(np.int64)), *kept.columns], ["bucket", "h", *batch.schema.names])

    return run


def _own_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first-ranking row of each text; rows come in order of (bucket, hash), and only the chain of one hash is held."""
    at: tuple | None = None
    chain: dict[str, tuple] = {}  # text: (rank, place in this batch or a batch of that row alone)
    for batch in batches:
        ids = pc.fill_null(pc.cast(batch.column("id"), pa.int64()), LOWEST).to_pylist()
        keys = zip(batch.column("bucket").to_pylist(), batch.column("h").to_pylist())
        here, done = [], []
        for i, (key, rank, text) in enumerate(zip(keys, ids, batch.column("key").to_pylist())):
            if key != at:
                for _, place in chain.values():
                    (here if isinstance(place, int) else done).append(place)
                at, chain = key, {}
            if text not in chain or rank > chain[text][0]:  # texts are compared whole, as keys of the chain
                chain[text] = (rank, i)
        yield from done
        if here:
            yield batch.take(pa.array(here))
        chain = {t: (rank, batch.take(pa.array([place])) if isinstance(place, int) else place) for t, (rank, place) in chain.items()}
    for _, place in chain.values():
        yield place


def drop_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that :func:`exact_dedup` keeps, with all their columns.

    Whole rows move once, to the owner of their text's bucket. Rows repeated
    with the same doc_id and text are one row afterwards.
    """
    rest = [c for c in docs.columns if c != "text"]
    empty = fresh_prefix(docs.columns)
    row = F.struct(*(F.col(f"`{c}`") for c in rest), F.col("text").isNull().alias(empty))  # the text itself is the key
    rows = docs.select(row.alias("row"), F.coalesce("text", F.lit("")).alias("key"), F.col("doc_id").cast("long").alias("id"))
    depth, slots = directory(rows.select(F.col("key").alias("text")), **options)
    schema = StructType.fromDDL("bucket long, h long").add("row", rows.schema["row"].dataType).add("key", "string").add("id", "long")
    best = arrow_map(_dealt(rows, _best_rows(depth, slots), schema), _own_rows, schema)
    text = F.when(~F.col("row")[empty], F.col("key"))
    return best.select(*((text if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns))
