"""Best-fit packing by non-negative least squares over length patterns.

Only the histogram of piece lengths (at most ``capacity`` numbers) reaches the
driver. There, patterns of one to three lengths that fill a sequence exactly
are enumerated, non-negative least squares fits how often each repeats, the
repeats are rounded to what the histogram still holds, and the residual
lengths are packed best-fit, again by counts and never piece by piece. Each
length's pieces are numbered over the whole corpus (local rank plus the counts
of the tasks before), and that number alone decides sequence and offset.

Defined results: a null text counts as empty and is the closing id alone; a
null doc_id passes through; repeated rows are pieces of their own; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import TABLES, arrow_map, id_text, stored_map, text_slices

_LATIN = "A-Za-zÀ-ÖØ-öø-įı-ɏ"
_PLAIN = re.compile(f"[!-~ \\t-\\r{_LATIN}]*").fullmatch
#: A space before white space: such a text can't be cut before each of its spaces.
_LOOSE = " [ \\t-\\r]"
_FIRST = "\x01"


class ByteTokenizer:
    """Ids of a byte-level BPE file.

    A space before a visible character always begins a word of the file's
    pattern, so plain texts are cut there; distinct cuts are encoded once and
    kept in a bounded table of ids. Other texts go through the library whole.
    """

    def __init__(self, path: str, keep: int = 150_000):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        from .token_counts import byte_chars

        self.rules = Tokenizer.from_file(path)
        spec = json.load(open(path, encoding="utf-8"))
        self.special = [t["content"] for t in spec["added_tokens"]]
        chars = byte_chars()
        ranks = {bytes(map(chars.__getitem__, w)): i for w, i in spec["model"]["vocab"].items() if w not in self.special}
        in_order = all(ranks[bytes(map(chars.__getitem__, a + b))] == 256 + i for i, (a, b) in enumerate(spec["model"]["merges"]))
        self.plain = in_order and spec["normalizer"] is None and spec["pre_tokenizer"].get("use_regex", False)
        pattern = f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LATIN}]+| ?[0-9]+| ?[^ \\t-\\r0-9{_LATIN}]+|[ \\t-\\r]+(?![^ \\t-\\r])|[ \\t-\\r]+"
        self.core = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.width = np.zeros(len(ranks), np.int64)
        for word, rank in ranks.items():
            self.width[rank] = len(word)
        self.keep = keep
        self.clear()
        TABLES.append(self.clear)

    def clear(self) -> None:
        self.cuts = pa.array([], pa.string())
        self.ids, self.ends = np.empty(0, np.uint32), np.zeros(1, np.int64)

    def _numbers(self, cuts: pa.Array) -> np.ndarray:
        """Each distinct cut's place in the table; new ones are encoded in one go."""
        if len(self.cuts) > self.keep:
            self.clear()
        found = pc.fill_null(pc.index_in(cuts, value_set=self.cuts), -1).to_numpy(False).astype(np.int64)
        begins = pc.starts_with(cuts, _FIRST).to_numpy(False)
        for mine in (np.nonzero((found < 0) & begins)[0], np.nonzero((found < 0) & ~begins)[0]):
            if not len(mine):
                continue
            new = cuts.take(pa.array(mine))
            if begins[mine[0]]:
                each = [self.core.encode_ordinary(cut[1:]) for cut in new.to_pylist()]
                ids = np.asarray([i for x in each for i in x], np.uint32)
                ends = np.cumsum([len(x) for x in each])
            else:
                whole = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(new)], pa.int32()), new), " ")[0].as_py()
                ids = np.asarray(self.core.encode_ordinary(" " + whole), np.uint32)
                stops = np.cumsum(pc.binary_length(new).to_numpy(False).astype(np.int64) + 1)
                ends = np.searchsorted(np.cumsum(self.width[ids]), stops) + 1
            found[mine] = len(self.cuts) + np.arange(len(mine))
            self.cuts = pa.concat_arrays([self.cuts, new])
            self.ends = np.concatenate([self.ends, len(self.ids) + ends])
            self.ids = np.concatenate([self.ids, ids])
        return found

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Unsigned 32-bit ids of each text."""
        rows = texts.to_pylist()
        easy = np.asarray([self.plain and _PLAIN(t) is not None and not any(s in t for s in self.special) for t in rows], bool)
        easy &= ~pc.match_substring_regex(texts, _LOOSE).to_numpy(False)
        out: list = [None] * len(rows)
        for i in np.nonzero(~easy)[0].tolist():
            out[i] = np.asarray(self.rules.encode(rows[i], add_special_tokens=False).ids, np.uint32)
        mine = np.nonzero(easy)[0]
        if len(mine):
            marked = pc.binary_join_element_wise(pa.scalar(_FIRST), texts.take(pa.array(mine)), "")
            lists = pc.split_pattern(marked, " ")
            coded = lists.flatten().dictionary_encode()
            number = self._numbers(coded.dictionary)[coded.indices.to_numpy()]
            ids, ends = self.ids, self.ends
            size = ends[number + 1] - ends[number]
            stop = np.cumsum(size)
            shift = (ends[number] - stop + size).astype(np.int32)
            flat = ids[np.arange(stop[-1] if len(stop) else 0, dtype=np.int32) + np.repeat(shift, size)]
            bounds = np.concatenate([[0], stop])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
            for k, i in enumerate(mine.tolist()):
                out[i] = flat[bounds[k] : bounds[k + 1]]
        return out


@lru_cache(maxsize=2)
def byte_tokenizer(path: str) -> ByteTokenizer:
    return ByteTokenizer(path)


def piece_table(docs: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    """Pieces, stored, with their task's number and their rank among its pieces of that length."""
    end = np.asarray([end_id], np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), Counter()
        machine = byte_tokenizer(path)
        for whole in batches:
            for batch in text_slices(whole):
                rows: list[tuple] = []
                for doc_id, ids in zip(batch.column("doc_id").to_pylist(), machine.encode(batch.column("text"))):
                    ids = np.concatenate([ids, end])
                    n = len(ids)
                    at, length, piece = 0, n % capacity or capacity, 0
                    while at < n:
                        crc = zlib.crc32(ids[at : at + length])
                        rows.append((doc_id, piece, at, length, crc, part, seen[length]))
                        seen[length] += 1
                        at, length, piece = at + length, capacity, piece + 1
                columns = zip(*rows)
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "place"]
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)

    return stored_map(docs, run, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, place long")


def patterns_of(capacity: int, present: np.ndarray, spread: int = 24) -> np.ndarray:
    """Patterns of up to three present lengths with sum ``capacity``; unused places are 0."""
    have = np.zeros(capacity + 1, bool)
    have[present] = True
    found = {(capacity, 0, 0)} if have[capacity] else set()
    for a in present.tolist():
        rest = capacity - a
        if 0 < rest <= a and have[rest]:
            found.add((a, rest, 0))
        low = max(1, rest - a)
        for b in {int(x) for x in np.linspace(-(-rest // 2), min(a, rest - 1), spread)} if rest > 1 else ():
            c = rest - b
            if c >= 1 and b <= a and b >= low - a and have[b] and have[c]:
                found.add((a, b, c))
    return np.asarray(sorted(found), np.int64).reshape(-1, 3)


def fit_repeats(patterns: np.ndarray, counts: np.ndarray, rounds: int = 1500) -> np.ndarray:
    """Non-negative least squares of the repeat counts by accelerated projected gradients."""
    used = patterns > 0

    def usage(x):
        u = np.zeros(len(counts))
        for k in range(3):
            u += np.bincount(patterns[used[:, k], k], x[used[:, k]], len(counts))
        return u

    def back(r):
        return (r[patterns] * used).sum(1)

    step = 1.0 / max(1.0, float(back(usage(np.ones(len(patterns)))).max()))
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0.0, y - step * back(usage(y) - counts))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t_new * (new - x)
        if np.abs(new - x).max() < 1e-4:
            x = new
            break
        x, t = new, t_new
    return x


def plan(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences) that use up the histogram."""
    left = counts.astype(np.int64).copy()
    out = []
    present = np.nonzero(left)[0]
    if not len(present):
        return out
    patterns = patterns_of(capacity, present)
    if len(patterns):
        x = fit_repeats(patterns, left.astype(float))
        for k in np.argsort(-x, kind="stable"):
            wanted = int(np.floor(x[k] + 0.5))
            if wanted <= 0:
                break
            parts = Counter(int(v) for v in patterns[k] if v)
            n = min(wanted, *(int(left[v]) // m for v, m in parts.items()))
            if n > 0:
                out.append((tuple(int(v) for v in patterns[k] if v), n))
                for v, m in parts.items():
                    left[v] -= m * n
    rooms: dict[int, list[list]] = {}  # free room: [lengths, how many]
    for length in range(capacity, 0, -1):
        todo = int(left[length])
        while todo:
            room = next((r for r in range(length, capacity) if rooms.get(r)), None)
            if room is None:
                fit = capacity // length
                full, last = divmod(todo, fit)
                for k, n in ((fit, full), (last, 1)):
                    if k and n:
                        rooms.setdefault(capacity - k * length, []).append([(length,) * k, n])
                break
            group = rooms[room][-1]
            n = min(todo, group[1])
            group[1] -= n
            if not group[1]:
                rooms[room].pop()
            rooms.setdefault(room - length, []).append([group[0] + (length,), n])
            todo -= n
    return out + [(tuple(g[0]), g[1]) for groups in rooms.values() for g in groups]


def intervals(sequences: list[tuple[tuple[int, ...], int]], capacity: int) -> dict[int, np.ndarray]:
    """Of each length: rows (first rank, first sequence, offset) in order of rank."""
    ranks, rows, base = Counter(), {}, 0
    for lengths, n in sequences:
        offset = 0
        for length in lengths:
            rows.setdefault(length, []).append((ranks[length], base, offset))
            ranks[length] += n
            offset += length
        base += n
    return {k: np.asarray(v, np.int64) for k, v in rows.items()}


def pack(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = piece_table(id_text(docs, id_col, text_col), path, capacity, end_id)
    by_task = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = by_task.groupBy("length").agg(F.sum("n").alias("n")).toArrow()  # ``capacity`` rows at most
    counts = np.zeros(capacity + 1, np.int64)
    counts[histogram.column("length").to_numpy()] = histogram.column("n").to_numpy()
    table = intervals(plan(counts, capacity), capacity)  # bounded by patterns, not by pieces
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_task.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for value in np.unique(length).tolist():
                mine = np.nonzero(length == value)[0]
                rows = table[value]
                at = np.searchsorted(rows[:, 0], rank[mine], "right") - 1
                sequence[mine] = rows[at, 1] + rank[mine] - rows[at, 0]
                offset[mine] = rows[at, 2]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"]
            )

    ranked = pieces.join(starts, ["part", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("earlier") + F.col("place")).alias("rank")
    )
    return arrow_map(
        ranked, place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
