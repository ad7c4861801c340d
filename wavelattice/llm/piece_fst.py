"""SentencePiece encoding and decoding by weighted finite-state transducers.

A model file is compiled to three transducers:

* the normaliser: the file's character map (longest match first, all other
  characters as they are), white space squeezed or not, the blank before the
  text, and spaces to the visible blank;
* the pieces: a trie over bytes whose final states emit a piece and weigh;
* the fallback: an arc over each character that no piece covers, which emits
  its bytes' pieces.

An input is composed with all three (:class:`Lattice` expands the product
position by position, for many inputs side by side), and the shortest path in
the tropical semiring is the encoding: weights add along a path and the least
total wins. Totals are single floats, as the format's own library has them;
among equals the path whose last arc begins first wins.

* A unigram model's arcs weigh minus their scores.
* A merge model's arcs weigh one each, and the product has one more factor:
  two arcs may follow one another only if they are the encoding of their own
  concatenation (weight infinity otherwise). Exactly one path is finite then:
  the result of the merges. :class:`BpeAutomaton` answers for pairs.

Where no piece of a merge model has a blank after another character, a lattice
splits before each run of blanks (and before marks for which the same holds),
and paths of distinct parts are kept in a bounded table. A unigram model's
texts go whole: how totals round depends on all that comes before.

Defined results: a null or empty text has no ids; text of any length is
encoded whole; characters outside the vocabulary become byte pieces (one
unknown piece for a run of them if the model has none); a U+2581 in a text
decodes to a space (``round_trip`` is false then); a null doc_id passes
through; repeated rows give repeated results; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe_automaton import NONE, BpeAutomaton
from .shared import TABLES, arrow_map, id_text, text_slices

BLANK = "▁"
#: Kinds of pieces in a model file (fixed values of the format).
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a serialised message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        if key & 7 == 0:
            value, at = varint(at)
        elif key & 7 == 2:
            size, at = varint(at)
            value, at = data[at : at + size], at + size
        else:
            size = 8 if key & 7 == 1 else 4
            value, at = data[at : at + size], at + size
        yield key >> 3, value


def read_model(path: str) -> dict:
    """Pieces (text, score, kind), model type and normaliser flags of a model file."""
    import struct

    out = {"pieces": [], "unigram": True, "dummy_prefix": True, "squeeze": True, "escape": True, "charsmap": b""}
    for field, value in _fields(open(path, "rb").read()):
        if field == 1:
            piece = dict(_fields(value))
            out["pieces"].append((piece.get(1, b"").decode(), struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0], piece.get(3, NORMAL)))
        elif field == 2:
            out["unigram"] = dict(_fields(value)).get(3, 1) == 1
        elif field == 3:
            spec = dict(_fields(value))
            out |= {"charsmap": spec.get(2, b""), "dummy_prefix": bool(spec.get(3, 1)), "squeeze": bool(spec.get(4, 1)), "escape": bool(spec.get(5, 1))}
    return out


def read_charsmap(blob: bytes) -> dict[str, str]:
    """All pairs of a compiled character map: a double array over bytes whose leaves point into a pool of strings."""
    if not blob:
        return {}
    size = int.from_bytes(blob[:4], "little")
    units, pool = np.frombuffer(blob, "<u4", size // 4, 4).tolist(), blob[4 + size :]
    offset = lambda u: (u >> 10) << ((u & 512) >> 6)
    found, todo = {}, [(offset(units[0]), b"")]
    while todo:
        at, key = todo.pop()
        for byte in range(1, 256):
            child = at ^ byte
            if child < len(units) and units[child] & 0x800000FF == byte:
                unit = units[child]
                below = child ^ offset(unit)
                if unit >> 8 & 1:
                    start = units[below] & 0x7FFFFFFF
                    found[key + bytes([byte])] = pool[start : pool.index(b"\0", start)]
                todo.append((below, key + bytes([byte])))
    return {k.decode("utf-8", "ignore"): v.decode() for k, v in found.items()}


class Normaliser:
    """Text to the pieces' alphabet."""

    def __init__(self, model: dict):
        self.map = read_charsmap(model["charsmap"])
        self.squeeze, self.prefix, self.escape = model["squeeze"], model["dummy_prefix"], model["escape"]
        keys = sorted(self.map, key=len, reverse=True)  # alternatives are tried in order: the longest first
        self.sub = re.compile("|".join(map(re.escape, keys))).sub if keys else None

    def __call__(self, text: str) -> str:
        if not text:
            return ""
        if self.sub:
            text = self.sub(lambda m: self.map[m.group()], text)
        if self.escape:
            text = text.replace(BLANK, " ")
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
            if not text:
                return ""
        text = " " * self.prefix + text
        return text.replace(" ", BLANK) if self.escape else text


class Lattice:
    """Pieces and fallback composed with inputs, and tropical shortest paths through them.

    ``weights``: by token; ``automaton``: the trie, and the answers for pairs
    where ``pairs`` is set.
    """

    def __init__(self, automaton: BpeAutomaton, weights: np.ndarray, fallback: float, pairs: bool, foreign):
        self.automaton, self.pairs, self.foreign = automaton, pairs, foreign
        self.fallback = len(weights)
        self.weights = np.append(weights, fallback).astype(np.float32)

    def _allowed(self, left: np.ndarray, token: np.ndarray) -> np.ndarray:
        if not self.pairs:
            return np.ones(len(token), bool)
        out = left == self.fallback
        todo = np.nonzero(~out)[0]
        out[todo] = self.automaton.fits(left[todo], token[todo])
        return out

    def paths(self, texts: list[str]) -> list[np.ndarray]:
        """Tokens of each text (not empty); ``fallback`` for each character without a piece."""
        out: list = [None] * len(texts)
        words = [t.encode() for t in texts]
        for part in self.automaton._alike(words):
            for i, path in zip(part, self._paths([texts[i] for i in part], [words[i] for i in part])):
                out[i] = path
        return out

    def _paths(self, texts: list[str], words: list[bytes]) -> list[np.ndarray]:
        trie = self.automaton
        lengths = np.fromiter(map(len, words), np.int32, len(words))
        n = int(lengths.max())
        flat = np.zeros((len(words), n), np.uint8)
        flat[np.arange(n) < lengths[:, None]] = np.frombuffer(b"".join(words), np.uint8)
        skip = np.zeros((len(words), n), np.int8)  # bytes of a character without a piece that begins there
        for r, text in enumerate(texts if self.foreign.search("".join(texts)) else ()):
            for m in self.foreign.finditer(text):
                skip[r, len(text[: m.start()].encode())] = len(m.group().encode())
        falls = bool(skip.any())
        best = np.full((len(words), n + 1), np.inf, np.float32)
        token = np.full((len(words), n + 1), NONE, np.int32)
        came = np.zeros((len(words), n + 1), np.int32)
        best[:, 0], token[:, 0] = 0, trie.start
        row = node = start = np.zeros(0, np.int32)

        def relax(r, first, end, t):
            total = best[r, first] + self.weights[t]
            if self.pairs:  # no two finite paths meet
                best[r, end], token[r, end], came[r, end] = total, t, first
                return
            order = np.lexsort((first, total, r))
            one = order[np.concatenate([[True], r[order][1:] != r[order][:-1]])]
            best[r[one], end], token[r[one], end], came[r[one], end] = total[one], t[one], first[one]

        for i in range(n):
            here = np.nonzero((lengths > i) & np.isfinite(best[:, i]))[0].astype(np.int32)
            row, node = np.concatenate([row, here]), np.concatenate([node, np.zeros(len(here), np.int32)])
            start = np.concatenate([start, np.full(len(here), i, np.int32)])
            node = np.where(lengths[row] > i, trie.next[node, flat[row, i]], NONE)
            keep = node != NONE
            row, node, start = row[keep], node[keep], start[keep]
            emits = trie.ends[0][node]
            can = np.nonzero(emits != NONE)[0]
            ok = can[self._allowed(token[row[can], start[can]], emits[can])]
            r, first, t = row[ok], start[ok], emits[ok]
            for n_bytes in range(1, min(4, i + 1) + 1) if falls else ():
                at = i + 1 - n_bytes
                jump = np.nonzero((skip[:, at] == n_bytes) & (lengths > i) & np.isfinite(best[:, at]))[0].astype(np.int32)
                r, first = np.concatenate([r, jump]), np.concatenate([first, np.full(len(jump), at, np.int32)])
                t = np.concatenate([t, np.full(len(jump), self.fallback, np.int32)])
            if len(r):
                relax(r, first, i + 1, t)
        at, live, steps = lengths.copy(), np.arange(len(words)), []
        while len(live):
            step = np.full(len(words), NONE, np.int32)
            step[live] = token[live, at[live]]
            steps.append(step)
            at[live] = came[live, at[live]]
            live = live[at[live] > 0]
        grid = np.stack(steps[::-1], axis=1)
        return [line[line != NONE] for line in grid]


class PieceTransducer:
    def __init__(self, model: dict, keep: int = 300_000):
        self.pieces, self.normalise = model["pieces"], Normaliser(model)
        self.prefix, self.squeeze, self.unigram = model["dummy_prefix"], model["squeeze"], model["unigram"]
        # what a unigram model marks unused is never chosen; user pieces weigh less than any other
        kinds = (NORMAL, USER) if self.unigram else (NORMAL, USER, UNUSED)
        scores = [s for _, s, kind in self.pieces if kind == NORMAL]
        low, high = min(scores, default=0.0), max(scores, default=0.0)
        score = lambda p, s, kind: float(np.float32(len(p.encode())) * np.float32(high)) - 0.1 if kind == USER else s
        arcs = {p: (i, -score(p, s, kind)) for i, (p, s, kind) in enumerate(self.pieces) if kind in kinds}
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(self.pieces) if kind == BYTE}
        self.unknown = next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)
        apart = not any(re.search(f"[^{BLANK}]{BLANK}", p) for p in arcs)
        # No path crosses a mark that no piece has after any other character.
        marks = "".join(c for c in ".,;:!?\n" if not any(re.search(f"[^{BLANK}.,;:!?\n]{re.escape(c)}", p) for p in arcs))
        self.cuts = re.compile(f"{BLANK}+[{marks}]*[^{BLANK}{marks}]*|[{marks}]+[^{BLANK}{marks}]*|[^{BLANK}{marks}]+" if marks else f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+").findall if apart else lambda t: [t] if t else []
        self.surface = [
            bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else " \u2047 ".encode() if kind == UNKNOWN else p.replace(BLANK, " ").encode()
            for p, _, kind in self.pieces
        ]
        chars = "".join(sorted(c for c in arcs if len(c) == 1))
        words = {p.encode(): i for p, (i, _) in arcs.items()}
        text = {i: p for p, (i, _) in arcs.items()}

        def merge(a: int, b: int):
            arc = arcs.get(text[a] + text[b])
            return arc and (arc[1], arc[0])

        automaton = BpeAutomaton(words, words, merge, lambda w, _: [arcs[c][0] for c in w.decode()])
        weights = np.ones(len(self.pieces))
        if self.unigram:
            for i, w in arcs.values():
                weights[i] = w
        self.lattice = Lattice(automaton, weights, 10.0 - low if self.unigram else 1.0, not self.unigram, re.compile(f"[^{re.escape(chars)}]"))
        self.keep, self.known = keep, {}
        TABLES.append(self.known.clear)

    def _ids(self, text: str, path: np.ndarray) -> bytes:
        if not self.lattice.foreign.search(text):
            return path.tobytes()
        out, chars, fell = array("i"), self.lattice.foreign.finditer(text), False
        for token in path.tolist():
            foreign = token == self.lattice.fallback
            if not foreign:
                out.append(token)
            elif self.bytes:
                out.extend(self.bytes[b] for b in next(chars).group().encode())
            elif not fell:
                out.append(self.unknown)
            fell = foreign
        return out.tobytes()

    def encode(self, texts: list[str]) -> list[array]:
        if len(self.known) > self.keep:
            self.known.clear()
        if self.unigram:
            shown = [self.normalise(t) for t in texts]
            some = [t for t in shown if t]
            ids = iter(map(self._ids, some, self.lattice.paths(some)))
            return [array("i", next(ids)) if t else array("i") for t in shown]
        cuts = [self.cuts(self.normalise(t)) for t in texts]
        new = list(set().union(*cuts).difference(self.known))
        if new:
            self.known.update(zip(new, map(self._ids, new, self.lattice.paths(new))))
        get, out = self.known.__getitem__, []
        for c in cuts:
            ids = array("i")
            ids.frombytes(b"".join(map(get, c)))
            out.append(ids)
        return out

    def decode(self, ids) -> str:
        """The inverse transducers: surfaces of the pieces, without the blank before the text."""
        surfaces = [self.surface[i] for i in ids]
        for k, part in enumerate(surfaces if self.squeeze or self.prefix else ()):
            if ids[k] != self.unknown:
                surfaces[k] = part.removeprefix(b" ")
            if surfaces[k] or part and not self.squeeze:  # all blanks at the beginning go, or one
                break
        return b"".join(surfaces).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def transducer(path: str) -> PieceTransducer:
    return PieceTransducer(read_model(path))


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_ids, n_fallback, ids_crc32, decoded_sha256, round_trip (and the ids themselves)."""
    names = ["doc_id", "n_bytes", "n_ids", "n_fallback", "ids_crc32", "decoded_sha256", "round_trip"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
    schema = "doc_id long, n_bytes long, n_ids long, n_fallback long, ids_crc32 long, decoded_sha256 string, round_trip boolean"
    if with_ids:
        names, kinds, schema = [*names, "ids"], [*kinds, pa.list_(pa.int32())], schema + ", ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        first = min(machine.bytes.values(), default=-1)
        last = max(machine.bytes.values(), default=-2)
        for whole in batches:
            for batch in text_slices(whole):
                texts, rows = batch.column("text").to_pylist(), []
                for doc_id, text, ids in zip(batch.column("doc_id").to_pylist(), texts, machine.encode(texts)):
                    back = machine.decode(ids)
                    low = sum(first <= i <= last for i in ids) if ids and min(ids) <= last else 0
                    row = (doc_id, len(text.encode()), len(ids), low, zlib.crc32(ids.tobytes()), hashlib.sha256(back.encode()).hexdigest(), back == text)
                    rows.append((*row, ids.tolist()) if with_ids else row)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names)

    return arrow_map(id_text(docs, id_col, text_col), run, schema)
