"""Toxicity by a weighted lexicon matched with Aho-Corasick.

Texts are folded first: lower case, homoglyphs and accents to plain letters,
digits and signs inside a word to the letters they stand for, all else to one
space. The lexicon holds whole words and beginnings of words; its weights are
learned from labelled rows as smoothed log odds of document frequencies, and a
greedy cover picks the entries that explain rows no other entry explains. One
automaton finds entries and exception phrases together: a hit inside an
exception phrase does not count. The weighted hits, as they are and divided by
the number of words, go through a logistic curve fitted to the same rows.

At most ``sample`` labelled rows are used for fitting (those with the least
hash of their id); the lexicon has at most ``entries`` entries.

Defined results: null and empty texts have no hits and get the score of the
curve there; text of any length is scored whole; without labelled rows of both
kinds the lexicon is empty and every score is 0; a null doc_id passes through;
repeated rows give repeated results; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import bisect
import heapq
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import TABLES, arrow_map, id_text, text_slices

# Letters of other scripts that look like Latin ones, and what
# digits and signs stand for inside a word.
HOMOGLYPHS = dict(zip("абвеіјкмнорстухԁԛѕԝүһӏαβεηικνορτυχωγ", "abbeijkmhopctyxdqswyhlabenikvoptuxwy"))
DIGITS = dict(zip("0134578@$!|", "oieastbasil"))
#: Phrases in which an entry is harmless.
EXCEPTIONS = ("trash can", "trash bin", "class clown", "clown fish", "sore loser bracket", "scum filter")

_PREFIXES = range(4, 8)


class _Fold(dict):
    """Translation of one character at a time, made when it is met."""

    def __missing__(self, code: int) -> str:
        c = chr(code).lower()
        c = unicodedata.normalize("NFKD", c)
        out = "".join(HOMOGLYPHS.get(x, x) for x in c if not unicodedata.combining(x))
        out = out if out and all(x.isalnum() or x in DIGITS or x == "ß" for x in out) else "" if c and all(map(unicodedata.combining, c)) else " "
        self[code] = out
        return out


_FOLD = _Fold()
TABLES.append(_FOLD.clear)
_LEET = re.compile(r"[a-z]*[0134578@$!|]+[a-z@$!|0-9]*")
_LEET_TABLE = str.maketrans(DIGITS)
_OTHER = re.compile(r"[^\w]+|_+")


def _unleet(m: re.Match) -> str:
    word = m.group()
    core = word.rstrip("!|")  # a mark after a word is a mark
    if not any("a" <= c <= "z" for c in core):
        return word
    return core.translate(_LEET_TABLE) + " " * (len(core) < len(word))


def fold(text: str) -> str:
    """Words between single spaces, with one at either end."""
    text = _LEET.sub(_unleet, text.translate(_FOLD))
    return f" {_OTHER.sub(' ', text).strip()} "


def candidates(folded: str) -> set[str]:
    """Entries a text can teach: its words and their beginnings."""
    words = set(folded.split())
    return {f" {w} " for w in words if len(w) > 2} | {" " + w[:n] for w in words for n in _PREFIXES if len(w) > n}


class Lexicon:
    """The automaton; ``weights`` by entry, the curve's numbers (bias, total, density)."""

    def __init__(self, weights: dict[str, float], exceptions: list[str], curve: tuple[float, float, float]):
        import ahocorasick

        self.weights, self.curve = weights, curve
        self.machine = ahocorasick.Automaton()
        for phrase in exceptions:
            self.machine.add_word(fold(phrase), (len(fold(phrase)), None))
        for entry, weight in weights.items():
            self.machine.add_word(entry, (len(entry), weight))
        if weights:
            self.machine.make_automaton()

    def features(self, text: str) -> tuple[float, float]:
        """Square root of the total weight of the hits, and the weight per word."""
        if not self.weights:
            return (0.0, 0.0)
        folded = fold(text)
        hits, safe = [], []
        for end, (n, weight) in self.machine.iter(folded):
            (safe if weight is None else hits).append((end - n + 1, end, weight))
        if safe:
            hits = [h for h in hits if not any(a <= h[0] and h[1] <= b for a, b, _ in safe)]
        total = sum(h[2] for h in hits)
        return (total**0.5, total / max(1, folded.count(" ") - 1))

    def score(self, text: str) -> float:
        if not self.weights:
            return 0.0
        bias, a, b = self.curve
        x, y = self.features(text)
        return float(1.0 / (1.0 + np.exp(-np.clip(bias + a * x + b * y, -30.0, 30.0))))


def fit_curve(x: np.ndarray, y: np.ndarray, rounds: int = 60, ridge: float = 1e-2) -> tuple[float, float, float]:
    """Logistic regression on two features by Newton's method."""
    scale = np.maximum(np.abs(x).max(0), 1e-9)
    m = np.column_stack([np.ones(len(x)), x / scale])
    w = np.zeros(3)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(m @ w, -30, 30)))
        h = (m * (p * (1 - p) + 1e-9)[:, None]).T @ m + ridge * np.eye(3)
        step = np.linalg.solve(h, m.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return (float(w[0]), float(w[1] / scale[0]), float(w[2] / scale[1]))


def cover(entries: list[str], purity: list[float], has: list[list[int]], least: int, most: int, fold_cover: int = 6) -> list[str]:
    """Greedy cover: entries that explain at least ``least`` rows not yet explained ``fold_cover`` times.

    Words that copies of one toxic text happen to share explain nothing new
    and stay out; ``purity`` multiplies what an entry explains. Among beginnings of one word the longest that explains
    nearly as much is taken.
    """
    rows_of: dict[str, list[int]] = {e: [] for e in entries}
    for row, found in enumerate(has):
        for e in found:
            rows_of[entries[e]].append(row)
    need = [fold_cover] * len(has)
    weight = dict(zip(entries, purity))
    gain = lambda e: sum(need[r] > 0 for r in rows_of[e])
    in_order = sorted(entries)
    heap = [(-gain(e) * weight[e], e) for e in entries]
    heapq.heapify(heap)
    out: set[str] = set()
    chosen: list[str] = []
    while heap and len(chosen) < most:
        claimed, top = heapq.heappop(heap)
        have = gain(top)
        if top in out or have < least:
            continue
        if -have * weight[top] > claimed:  # gains only fall: put back what has fallen behind
            heapq.heappush(heap, (-have * weight[top], top))
            continue
        longer = []
        for e in in_order[bisect.bisect_left(in_order, top) :]:
            if not e.startswith(top):
                break
            if e not in out and gain(e) >= max(least, 0.97 * have):
                longer.append(e)
        best = max(longer, key=lambda e: (len(e), e))
        chosen.append(best)
        for r in rows_of[best]:
            need[r] -= 1
        for e in in_order[bisect.bisect_left(in_order, best) :]:
            if not e.startswith(best):
                break
            out.add(e)
        out.update(best[:n] for n in range(1, len(best)))
    return chosen


def fit(docs: DataFrame, labels: DataFrame, sample: int = 20_000, entries: int = 4_000, least: int = 3, odds: float = 3.0, evidence_least: float = 12.0) -> Lexicon:
    """Learn from the rows of ``labels`` (doc_id, toxic) whose crc32(doc_id) mod 5 is not 0."""
    fold_in = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
        .filter(fold_in)
        .orderBy(F.xxhash64("doc_id"), "toxic")
        .limit(sample)
    )
    rows = id_text(docs).join(F.broadcast(known), "doc_id").select("text", "toxic")  # ``sample`` ids at most

    def teach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found.update(candidates(fold(text)))
                found[""] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(found)), pa.array(list(found.values()), pa.int64())], ["entry", "n"])

    toxic = arrow_map(rows.filter("toxic = 1").select("text"), teach, "entry string, n long")
    sums = toxic.groupBy("entry").agg(F.sum("n").alias("n")).filter((F.col("n") >= least) | (F.col("entry") == ""))
    top = sums.orderBy(F.col("entry") != "", F.desc("n"), "entry").limit(10 * entries).toArrow()
    seen = dict(zip(top.column(0).to_pylist(), top.column(1).to_pylist()))
    n_toxic = seen.pop("", 0)
    wanted = frozenset(seen)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found.update(wanted & candidates(fold(text)))
                found[""] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["entry", "n"])

    counted = arrow_map(rows.filter("toxic = 0").select("text"), clean, "entry string, n long").groupBy("entry").agg(F.sum("n").alias("n")).toArrow()
    other = dict(zip(counted.column(0).to_pylist(), counted.column(1).to_pylist()))
    n_clean = other.pop("", 0)
    if not n_toxic or not n_clean:
        return Lexicon({}, [], (0.0, 0.0, 0.0))
    rate = n_toxic / (n_toxic + n_clean)
    odd = {}
    for entry, n in seen.items():
        total = n + other.get(entry, 0)
        share = n / total
        evidence = total * (share * np.log(share / rate) + ((1 - share) * np.log((1 - share) / (1 - rate)) if share < 1 else 0.0))
        weight = float(np.log((n + 0.5) / (n_toxic + 1)) - np.log((other.get(entry, 0) + 0.5) / (n_clean + 1)))
        if share > rate and evidence >= evidence_least and weight >= odds:
            odd[entry] = weight
    entry_at = {e: i for i, e in enumerate(sorted(odd))}

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(entry_at[c] for c in candidates(fold(t)) if c in entry_at) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32()))], ["has"])

    has = arrow_map(rows.filter("toxic = 1").select("text"), hold, "has array<int>").toArrow().column(0).to_pylist()  # ``sample`` rows at most
    weights = {e: odd[e] for e in cover(sorted(odd), [odd[e] ** 2 for e in sorted(odd)], has, max(least, -(-n_toxic // 100)), entries)}
    draft = Lexicon(weights, list(EXCEPTIONS), (0.0, 0.0, 0.0))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lexicon(weights, list(EXCEPTIONS), (0.0, 0.0, 0.0))
        for batch in batches:
            found = [own.features(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.float64()), batch.column(1)], ["x", "y", "toxic"])

    points = arrow_map(rows, measure, "x double, y double, toxic int").toArrow()  # ``sample`` rows at most
    order = np.lexsort([points.column(k).to_numpy() for k in range(3)])  # the same sums in any order of tasks
    x = np.column_stack([points.column(0).to_numpy(), points.column(1).to_numpy()])[order]
    return Lexicon(draft.weights, list(EXCEPTIONS), fit_curve(x, points.column(2).to_numpy()[order].astype(float)))


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    weights, curve = lexicon.weights, lexicon.curve

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lexicon(weights, list(EXCEPTIONS), curve)
        for whole in batches:
            for batch in text_slices(whole):
                found = np.asarray([own.score(t) for t in batch.column("text").to_pylist()], np.float64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found), pa.array((found >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    out = arrow_map(id_text(docs, id_col, text_col), run, "doc_id long, score double, predicted int")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` (all columns) whose score is below one half."""
    lexicon = fit(docs, labels)
    weights, curve = lexicon.weights, lexicon.curve
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lexicon(weights, list(EXCEPTIONS), curve)
        for batch in batches:
            keep = [own.score(t or "") < 0.5 for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return arrow_map(docs, run, docs.schema)
