"""Token counts by finite-state tokenizer compilation.

Two deterministic transducers are compiled from a tokenizer's vocabulary file:

* the inner one (:mod:`bpe_automaton`) reads the bytes of a word; its
  transitions emit token counts, and where a word ends they are added up;
* the outer one reads characters and tells where words begin and end. Its
  states are: between words, inside a run of letters, inside a run of signs.

A text is cut into chunks of about ``chunk_chars`` characters, words or no
words. Each chunk is compiled by itself to a *state map*: a finite table from
the state it is entered with (between words, or inside a word with a state of
the inner transducer) to the state it leaves and the tokens it emits. A chunk
that begins inside a word doesn't know the inner state it will be entered
with; it is compiled for the state that the characters just before it suggest,
and a table that lacks an entry is completed when the entry is met, from the
rest of that one word. Maps compose associatively, and a parallel prefix scan
composes them.

Normalising and splitting into words follow the file's own rules. Distinct
words are kept in bounded tables, as most text repeats them.

Defined results: a null or empty text has 0 tokens; special strings inside a
text count as the file says (one token each); a null doc_id passes through;
repeated rows give repeated results; text of any length, unbroken text too, is
counted whole; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe_automaton import BpeAutomaton, CountStates
from .shared import TABLES, arrow_map, id_text, text_slices

#: White space of the tokenizer's pattern language (fixed values: Unicode White_Space).
SPACE = "\t\n\x0b\x0c\r \x85\xa0                　"
_SPLIT = re.compile(f"[{SPACE}]+")
_SPACES = frozenset(SPACE)
#: Segments that no normal form changes but case, and how the file's pattern splits them.
_LATIN = "A-Za-zÀ-ÖØ-öø-įı-ɏ"
_PLAIN = re.compile(f"[!-~ \\t-\\r{_LATIN}]*").fullmatch
_PLAIN_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LATIN}]+|[0-9]|[^ \\t-\\r0-9{_LATIN}]+").findall
_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def byte_chars() -> dict[str, int]:
    """The printable stand-in of each byte, as byte-level vocabularies write them."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordTokenizer:
    """A byte-level BPE file with word ends, compiled."""

    def __init__(self, path: str, keep: int = 200_000):
        import json

        from tokenizers import Tokenizer

        self.rules = Tokenizer.from_file(path)
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.cut = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        suffix = model.get("end_of_word_suffix") or ""
        chars = byte_chars()
        vocab = model["vocab"]
        inner, final = {}, {}
        for word, token in vocab.items():
            ends = bool(suffix) and word.endswith(suffix)
            bare = word[: len(word) - len(suffix)] if ends else word
            if bare and all(c in chars for c in bare) and word not in self.special:
                (final if ends or not suffix else inner)[bytes(chars[c] for c in bare)] = token
        if not suffix:
            inner = final
        ranks = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            ranks[vocab[a], vocab[b]] = (rank, vocab[a + b])
        one = [{b: known[bytes([b])] for b in range(256) if bytes([b]) in known} for known in (inner, final)]

        def symbols(word: bytes, is_final: bool) -> list[int]:
            ids = [one[0][b] for b in word]
            if is_final and suffix:
                ids[-1] = one[1][word[-1]]
            return ids

        self.words = BpeAutomaton(inner, final, lambda a, b: ranks.get((a, b)), symbols)
        self.chars = chars
        #: The short way below holds for this pattern and these normalisers alone.
        self.plain = json.dumps(_PATTERN) in json.dumps(spec["pre_tokenizer"]) and [
            n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])
        ] == ["NFC", "Replace", "Lowercase"]
        self.keep = keep
        self.known: dict[str, int] = {}
        self.byte_words: dict[bytes, int] = {}
        self.plain_words: dict[str, int] = {}
        self.states = CountStates(self.words)
        self.firsts = _composing()
        TABLES.append(self.clear)

    def clear(self) -> None:
        for table in (self.known, self.byte_words, self.plain_words, self.states):
            table.clear()

    def _run(self, words: set, table: dict, encode) -> None:
        new = list(words.difference(table))
        if new:
            table.update(zip(new, self.words.counts([encode(w) for w in new]).tolist()))

    def words_of(self, text: str) -> list[bytes]:
        """The words of a text without special strings, by the file's own normaliser and splitter."""
        normal, pre = self.rules.normalizer, self.rules.pre_tokenizer
        return [bytes(map(self.chars.__getitem__, word)) for word, _ in pre.pre_tokenize_str(normal.normalize_str(text) if normal else text)]

    def _learn(self, segments: list[str]) -> None:
        """Any text by the file's own normaliser and splitter."""
        split, base = [], []
        for segment in segments:
            parts, extra = [segment], 0
            if self.cut and (found := self.cut.findall(segment)):
                parts, extra = self.cut.split(segment), len(found)
            split.append([w for part in parts if part for w in self.words_of(part)])
            base.append(extra)
        self._run({w for words in split for w in words}, self.byte_words, lambda w: w)
        get = self.byte_words.__getitem__
        for segment, words, extra in zip(segments, split, base):
            self.known[segment] = extra + sum(map(get, words))

    def counts(self, pieces: list[str]) -> list[int]:
        """Tokens of each piece of text; a piece begins and ends with a segment."""
        for table in (self.known, self.byte_words, self.plain_words):
            if len(table) > self.keep:
                table.clear()
        easy = [self.plain and (not self.cut or not self.cut.search(p)) and _PLAIN(p) is not None for p in pieces]
        words = [_PLAIN_WORDS(p.lower()) if e else _split(p) for p, e in zip(pieces, easy)]
        self._run(set().union(*(w for w, e in zip(words, easy) if e)), self.plain_words, str.encode)
        if not all(easy):
            self._learn(list(set().union(*(w for w, e in zip(words, easy) if not e)).difference(self.known)))
        gets = (self.known.__getitem__, self.plain_words.__getitem__)
        return [sum(map(gets[e], w)) for w, e in zip(words, easy)]


def _split(text: str) -> list[str]:
    return [s for s in _SPLIT.split(text) if s]


BETWEEN, LETTERS, SIGNS = 0, 1, 2
#: Inside a text of one chunk's length a place to cut is looked for so far on.
_LOOK = 64


def _composing() -> frozenset[str]:
    """Characters that a normal form may join to the one before: marks, and second halves of compositions."""
    second = set()
    for code in range(sys.maxunicode + 1):
        parts = unicodedata.decomposition(chr(code)).split()
        if len(parts) == 2 and parts[0][0] != "<":
            second.add(chr(int(parts[1], 16)))
    return frozenset(second | {chr(c) for c in range(0x1161, 0x11C3)})


def _place(machine: WordTokenizer, text: str, at: int) -> int | None:
    """The outer state at ``at`` if a text can be cut there, else None."""
    a, b = text[at - 1], text[at]
    if b in _SPACES or a in _SPACES and not unicodedata.combining(b) and b not in machine.firsts:
        return BETWEEN
    if unicodedata.combining(a) or unicodedata.combining(b) or b in machine.firsts or "'" in text[max(0, at - 3) : at + 1]:
        return None
    kind = unicodedata.category(a)[0] + unicodedata.category(b)[0]
    if a.isascii() and a.isdigit() or b.isascii() and b.isdigit():
        return BETWEEN
    if kind == "LL":  # as long as no normal or lower form of the one before ends in a mark
        return LETTERS if unicodedata.normalize("NFC", a).lower().isalpha() and unicodedata.normalize("NFC", b)[0].lower()[0].isalpha() else None
    return SIGNS if kind == "PP" else None


def chunks_of(machine: WordTokenizer, text: str, size: int) -> list[tuple[str, int]]:
    """(chunk, the outer state it is entered with); special strings are never cut."""
    special = [m.span() for m in machine.cut.finditer(text)] if machine.cut and len(text) > size else []
    cuts, at, k = [(0, BETWEEN)], size, 0
    while at < len(text):
        while k < len(special) and special[k][1] < at:
            k += 1
        inside = k < len(special) and special[k][0] <= at <= special[k][1]
        place = None if inside else _place(machine, text, at)
        if place is None:
            at += 1
            continue
        if place != BETWEEN:  # a place between words close by is better
            better = next((x for x in range(at + 1, min(len(text), at + _LOOK)) if text[x] in _SPACES), None)
            if better is not None and not any(a <= better <= b for a, b in special[k : k + 2]):
                at, place = better, BETWEEN
        cuts.append((at, place))
        at += size
    ends = [c[0] for c in cuts[1:]] + [len(text)]
    return [(text[a:b], kind) for (a, kind), b in zip(cuts, ends)]


class StateMap:
    """Entry state to (state left, tokens emitted). A state: None between words, else (inner state, byte to come)."""

    def __init__(self, table: dict, complete):
        self.table, self.complete = table, complete

    def __call__(self, entry):
        if entry not in self.table:
            self.table[entry] = self.complete(entry)
        return self.table[entry]

    def then(self, other: StateMap) -> StateMap:
        def both(entry):
            middle, n = self(entry)
            left, more = other(middle)
            return left, n + more

        return StateMap({entry: both(entry) for entry in self.table}, both)


def scan(maps: list[StateMap]) -> list[StateMap]:
    """Maps of all prefixes in a logarithmic number of rounds."""
    maps, step = list(maps), 1
    while step < len(maps):
        maps = [m if i < step else maps[i - step].then(m) for i, m in enumerate(maps)]
        step *= 2
    return maps


def _read(states: CountStates, entry, data: bytes):
    """The state inside a word after more of its bytes, and what they emit."""
    state, byte = entry or (0, None)
    n = 0
    for nxt in data:
        if byte is not None:
            state, emitted = states.move(state, byte)
            n += emitted
        byte = nxt
    return (state, byte), n


def close(states: CountStates, state) -> int:
    """What a text's end emits."""
    return 0 if state is None else states.final(*state)


def _compile(machine: WordTokenizer, chunk: str, entered: int, left: int, before: str) -> StateMap:
    """A chunk of a text of several. ``left``: the outer state at its end; ``before``: the text just before it."""
    parts = machine.cut.split(chunk) if machine.cut else [chunk]
    words = [w for part in parts if part for w in machine.words_of(part)] if entered != BETWEEN or left != BETWEEN else []
    if not words:
        n = machine.counts([chunk])[0]
        return StateMap({None: (None, n)}, lambda entry: (None, n + close(machine.states, entry)))
    head = words.pop(0) if entered != BETWEEN else None
    tail = words.pop() if left != BETWEEN and words else None
    whole = left != BETWEEN and tail is None and head is not None  # one word goes all the way through
    machine._run(set(words), machine.byte_words, lambda w: w)
    inside = sum(map(machine.byte_words.__getitem__, words)) + len(parts) - 1  # a special string is a token
    after = _read(machine.states, None, tail) if tail is not None else (None, 0)

    def complete(entry):
        n = 0
        if head is not None:
            entry, n = _read(machine.states, entry, head)
            if whole:
                return entry, n
            n += close(machine.states, entry)
        return after[0], n + inside + after[1]

    entry = None
    if head is not None and (guess := machine.words_of(before)):
        entry = _read(machine.states, None, guess[-1])[0]
    return StateMap({entry: complete(entry)}, complete)


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def count_texts(texts: list[str], path: str, chunk_chars: int = 1 << 16) -> list[int]:
    machine = tokenizer(path)
    cut = [chunks_of(machine, t, chunk_chars) for t in texts]
    alone = iter(machine.counts([c[0][0] for c in cut if len(c) == 1]))
    out = []
    for chunks in cut:
        if len(chunks) == 1:  # entered and left between words: a table of one entry
            out.append(next(alone))
            continue
        if len(machine.states.states) > machine.states.keep:
            machine.states.clear()
        maps = []
        for k, (chunk, entered) in enumerate(chunks):
            left = chunks[k + 1][1] if k + 1 < len(chunks) else BETWEEN
            maps.append(_compile(machine, chunk, entered, left, chunks[k - 1][0][-_LOOK:] if k else ""))
        state, n = scan(maps)[-1](None)
        out.append(n + close(machine.states, state))
    return out


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, chunk_chars: int = 1 << 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole):
                texts = batch.column("text").to_pylist()
                n = np.asarray(count_texts(texts, path, chunk_chars), np.int64)
                size = np.fromiter((len(t.encode()) for t in texts), np.int64, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(size), pa.array(n), pa.array(n > limit)],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    return arrow_map(id_text(docs, id_col, text_col), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
