"""Substring deduplication over a log-structured fingerprint index.

A window is ``size`` consecutive words of a document. Windows next to each
other mostly share their least hash of ``anchor`` words (their minimiser);
such a stretch of windows is one fingerprint: the minimiser's hash, and a
digest of the stretch's words (16 bytes of BLAKE2b over the words themselves,
no word's hash in it) that verifies it. Documents come in batches in order of
doc_id. A batch's fingerprints are merge-joined with each of the sorted
immutable runs of the batches before, co-located by buckets; what no run has
becomes a further run, and more than ``fanout`` runs are compacted to one.

What repeats in a batch follows from that join alone: a stretch whose words
the runs, or the batch itself, have under a smaller doc_id. Equal windows have
equal minimisers, so windows that repeat inside unlike stretches show as a
minimiser under several digests. For these, and only these, the windows' own
digests are compared, read anew from the texts of first documents.

Defined results: a null or empty text has no words; documents of fewer words
than ``size`` lose none; a null doc_id ranks above all others (so does the id
2^63 - 1, which comes back null); windows of rows with the same doc_id don't
remove each other; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import arrow_map, bucketed, id_text, maybe_in, stored, stored_map, text_slices
from .word_hashes import hashes, rolling, sliding_min, words_of

HIGHEST = 2**63 - 1
_KEYS = ["m", "d"]
_RUN = pa.struct([("m", pa.int64()), ("d", pa.binary()), ("n", pa.int32()), ("at", pa.list_(pa.int32()))])
_SCHEMA = "doc long, th long, n_words long, sha string, runs array<struct<m:bigint,d:binary,n:int,at:array<int>>>"


def _sha(words: list[str]) -> str:
    return hashlib.sha256(" ".join(words).encode("utf-8", "surrogatepass")).hexdigest()


def _bytes_of(words: list[str]) -> tuple[memoryview, list[int]]:
    """The words joined by one space, and where each begins (one place more, as if a word followed)."""
    joined = " ".join(words)
    data = joined.encode("utf-8", "surrogatepass")
    sizes = map(len, words) if len(data) == len(joined) else (len(w.encode("utf-8", "surrogatepass")) for w in words)
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.fromiter(sizes, np.int64, len(words)) + 1, out=starts[1:])
    return memoryview(data), starts.tolist()


def _digest(data: memoryview, starts: list[int], first: int, stop: int) -> bytes:
    return hashlib.blake2b(data[starts[first] : starts[stop] - 1], digest_size=16).digest()


def stretches(words: list[str], size: int, anchor: int, hash_bits: int = 64) -> dict[bytes, tuple[int, int, list[int]]]:
    """digest: (minimiser, number of windows, where they begin), of a document's distinct stretches."""
    if len(words) < size:
        return {}
    m = sliding_min(rolling(hashes(words) >> np.uint64(64 - hash_bits), anchor), size - anchor + 1)
    cut = np.concatenate([[0], np.nonzero(m[1:] != m[:-1])[0] + 1, [len(m)]])
    data, starts = _bytes_of(words)
    found: dict[bytes, tuple[int, int, list[int]]] = {}
    for at, stop, least in zip(cut.tolist(), cut[1:].tolist(), m[cut[:-1]].view(np.int64).tolist()):
        found.setdefault(_digest(data, starts, at, stop + size - 1), (least, stop - at, []))[2].append(at)
    return found


def fingerprints(docs: DataFrame, size: int, anchor: int, hash_bits: int) -> DataFrame:
    """``docs``: doc, th, text. One row a document, stored, with its stretches of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole):
                counts, shas, runs = [], [], []
                for text in batch.column("text").to_pylist():
                    words = words_of(text)
                    counts.append(len(words))
                    shas.append(_sha(words))
                    runs.append([{"m": m, "d": d, "n": n, "at": at} for d, (m, n, at) in stretches(words, size, anchor, hash_bits).items()])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc"), batch.column("th"), pa.array(counts, pa.int64()), pa.array(shas, pa.string()), pa.array(runs, pa.list_(_RUN))],
                    ["doc", "th", "n_words", "sha", "runs"],
                )

    return stored_map(docs, run, _SCHEMA)


class FingerprintIndex:
    """Sorted immutable runs of (m, d, first, place): a fingerprint, its first document, and where that has it.

    A fingerprint is in one run alone. ``runs`` of an earlier index go on here.
    """

    def __init__(self, fanout: int = 2, runs: list[DataFrame] | None = None):
        self.fanout, self.runs, self.compactions = fanout, list(runs or []), 0

    def entries(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.runs)

    def add(self, batch: DataFrame) -> DataFrame:
        """Index a batch (m, d, doc, th, n, at) whose documents come after all others; (m, d, seen) of its fingerprints that any document has before, or two of its own have."""
        own = batch.groupBy(*_KEYS).agg(F.min(F.struct("doc", "th", "n", "at")).alias("own"), F.count("*").alias("rows"))
        seen = own
        for k, run in enumerate(self.runs):  # one merge join a run
            seen = seen.join(run.select(*_KEYS, F.struct(F.col("first.doc").alias("doc"), F.col("first.th").alias("th")).alias(f"old{k}")), _KEYS, "left")
        old = [F.col(f"old{k}") for k in range(len(self.runs))]
        first = F.coalesce(*old, F.struct("own.doc", "own.th"))
        fresh = F.coalesce(*old).isNull() if old else F.lit(True)
        found = bucketed(seen.select(*_KEYS, first.alias("seen"), F.col("own").alias("first"), fresh.alias("fresh"), "rows"), _KEYS, dealt=True)
        self.runs.append(found.filter("fresh").select(*_KEYS, "first"))
        if len(self.runs) > self.fanout:
            self.runs, self.compactions = [bucketed(self.entries(), _KEYS)], self.compactions + 1
        return found.filter("NOT fresh OR rows > 1").select(*_KEYS, "seen")


def _windows(size: int):
    """Digests of the windows of the stretches that are to be compared one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc", "th", "pos", "w"]
        for whole in batches:
            for batch in text_slices(whole):
                for doc, th, text, runs in zip(batch.column("doc").to_pylist(), batch.column("th").to_pylist(), batch.column("text").to_pylist(), batch.column("todo").to_pylist()):
                    data, starts = _bytes_of(words_of(text))
                    mine = sorted({k for r in runs for at in r["at"] for k in range(at, at + r["n"])})
                    w = [_digest(data, starts, k, k + size) for k in mine]
                    n = len(mine)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, doc, np.int64)), pa.array(np.full(n, th, np.int64)), pa.array(mine, pa.int32()), pa.array(w, pa.binary())], names
                    )

    return run


def _apply(size: int):
    """What is left of a text once the windows' words are gone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole):
                removed, shas, texts = [], [], []
                for text, whole_runs, single in zip(*(batch.column(c).to_pylist() for c in ("text", "whole", "single"))):
                    words = words_of(text)
                    change = np.zeros(len(words) + 1, np.int64)
                    for at, n in [(at, r["n"]) for r in whole_runs or () for at in r["at"]] + [(at, 1) for at in single or ()]:
                        change[at] += 1
                        change[at + n + size - 1] -= 1
                    covered = np.cumsum(change)[:-1] > 0
                    kept = [w for w, c in zip(words, covered.tolist()) if not c]
                    removed.append(int(covered.sum()))
                    shas.append(_sha(kept))
                    texts.append(" ".join(kept))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc"), batch.column("th"), pa.array(removed, pa.int64()), pa.array(shas), pa.array(texts)], ["doc", "th", "n_removed", "kept_sha", "kept_text"]
                )

    return run


def dedup_substrings(docs: DataFrame, size: int = 50, anchor: int = 8, batches: int = 4, hash_bits: int = 64, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, index: FingerprintIndex | None = None, history: DataFrame | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and, for changed documents, kept_text).

    A corpus that grows is deduplicated piece by piece: ``index`` holds the
    fingerprints of earlier documents, all of smaller ids, and ``history`` the
    documents themselves, of which only those are read whose windows are to be
    compared; ``docs`` are added to the index. ``hash_bits`` of a word's hash
    are used: fewer make more minimisers meet, and no result differ.
    """
    named = lambda df: id_text(df, id_col, text_col).select(F.coalesce("doc_id", F.lit(HIGHEST)).alias("doc"), F.xxhash64("text").alias("th"), "text")
    rows = named(docs)
    seen = fingerprints(rows, size, anchor, hash_bits)
    some = batches > 1 and seen.limit(1).count() > 0
    cuts = sorted(set(seen.approxQuantile("doc", [k / batches for k in range(1, batches)], 0.01))) if some else []
    index = FingerprintIndex() if index is None else index
    found = []
    for k in range(len(cuts) + 1):
        part = seen if not cuts else seen.filter(F.col("doc") >= int(cuts[k - 1])) if k == len(cuts) else seen.filter(F.col("doc") < int(cuts[0])) if not k else seen.filter((F.col("doc") >= int(cuts[k - 1])) & (F.col("doc") < int(cuts[k])))
        batch = part.select("doc", "th", F.explode("runs").alias("x")).select("doc", "th", "x.m", "x.d", "x.n", "x.at")
        repeated, key = stored(index.add(batch), small=True), F.xxhash64(*_KEYS)  # a join of two plain shuffles: a passage that many share is split there
        hits = maybe_in(batch, key, repeated, key).join(repeated, _KEYS).filter((F.col("seen.doc") < F.col("doc")) | (F.col("seen.th") != F.col("th")))
        found.append(stored(hits.select("doc", "th", "m", "n", "at", (F.col("seen.doc") < F.col("doc")).alias("repeat"))))
    found = reduce(DataFrame.unionByName, found)
    entries = index.entries().select("m", "first.*")
    several = stored(entries.groupBy("m").agg(F.count("*").alias("c")).filter("c > 1").select("m"), small=True)
    own = entries.unionByName(found.filter(~F.col("repeat")).select("m", "doc", "th", "n", "at"))
    todo = stored(own.join(several, "m").groupBy("doc", "th").agg(F.collect_set(F.struct("n", "at")).alias("todo")))
    whole = stored(found.filter("repeat").groupBy("doc", "th").agg(F.collect_set(F.struct("n", "at")).alias("whole")))
    key_hash = F.xxhash64("doc", "th")
    every = rows if history is None else rows.unionByName(named(history))
    near = maybe_in(every, key_hash, todo, key_hash)
    windows = stored_map(near.join(todo, ["doc", "th"]), _windows(size), "doc long, th long, pos int, w binary")
    owner = windows.groupBy("w").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).filter("first < last")
    owner = stored(owner.select("w", "first"), small=True)  # a join of two plain shuffles: a passage that many share is split there
    late = windows.join(owner, "w").filter("first < doc")
    single = stored(late.groupBy("doc", "th").agg(F.collect_set("pos").alias("single")), small=True)
    gone = stored(whole.join(single, ["doc", "th"], "full"))
    near = maybe_in(rows, key_hash, gone, key_hash)
    changed = arrow_map(near.join(gone, ["doc", "th"]), _apply(size), "doc long, th long, n_removed long, kept_sha string, kept_text string")
    if not with_text:
        changed = changed.drop("kept_text")
    changed = changed.dropDuplicates(["doc", "th"])
    out = seen.select("doc", "th", "n_words", "sha").join(changed, ["doc", "th"], "left")
    more = ["kept_text"] if with_text else []
    return out.select(
        F.nullif("doc", F.lit(HIGHEST)).alias("doc_id"),
        "n_words",
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("kept_sha", "sha").alias("kept_sha256"),
        *more,
    )
