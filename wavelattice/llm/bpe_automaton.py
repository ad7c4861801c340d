"""A byte-pair vocabulary compiled to a deterministic transducer.

A sequence of tokens is the encoding of a word exactly when every adjacent
pair is the encoding of its own concatenation. So the encoding of every prefix
ends in one known token, found among the vocabulary's entries that end there
by the pair test alone. A state is what a prefix leaves open: for every start
that can still become a token its trie node, the token before it, and how many
tokens its prefix has more or less than the whole. Reading one more symbol
moves the nodes; the transition's output is the change of the token count.

:class:`BpeAutomaton` runs many words side by side, position by position, all
open starts of all words in numpy arrays with the counts they carry.
:class:`CountStates` numbers the states as they are met and keeps their
transitions, for words that are read in parts.
"""

from __future__ import annotations

import heapq

import numpy as np

NONE = -1


class BpeAutomaton:
    """``tokens``: symbol strings as tuples of ints below 256; ``merge``: (id, id) to (rank, id).

    ``final`` holds tokens that can only end a word (their last symbol is the
    word-final form), ``inner`` those that end anywhere else. Where the two
    forms don't differ, the same dict is given twice.
    """

    def __init__(self, inner: dict[bytes, int], final: dict[bytes, int], merge, symbols):
        self.merge, self.symbols = merge, symbols
        n_tokens = max([*inner.values(), *final.values()]) + 1
        self.start = n_tokens
        nodes: list[dict[int, int]] = [{}]
        ends = ([NONE], [NONE])
        for kind, known in enumerate((inner, final)):
            for word, token in known.items():
                at = 0
                for byte in word:
                    nxt = nodes[at].get(byte)
                    if nxt is None:
                        nxt = nodes[at][byte] = len(nodes)
                        nodes.append({})
                        ends[0].append(NONE)
                        ends[1].append(NONE)
                    at = nxt
                ends[kind][at] = token
        self.next = np.full((len(nodes), 256), NONE, np.int32)
        for at, moves in enumerate(nodes):
            for byte, nxt in moves.items():
                self.next[at, byte] = nxt
        self.ends = tuple(np.asarray(x, np.int32) for x in ends)
        self.text = {t: (w, k) for k, known in enumerate((inner, final)) for w, t in known.items()}
        self.width = np.ones(n_tokens + 1, np.int32)
        for token, (word, _) in self.text.items():
            self.width[token] = len(word)
        self._keys = np.full(1 << 16, NONE, np.int64)
        self._fits = np.zeros(1 << 16, bool)
        self._held = 0

    def brute(self, word: bytes, is_final: bool = True) -> list[int]:
        """The merges in order of rank, leftmost first: the definition itself."""
        ids = self.symbols(word, is_final)
        n = len(ids)
        after, before = [*range(1, n), NONE], [NONE, *range(n - 1)]
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j != NONE and (m := self.merge(ids[i], ids[j])) is not None:
                heapq.heappush(heap, (m[0], i, ids[i], ids[j], m[1]))

        for i in range(n):
            offer(i)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j == NONE or ids[j] != b:
                continue
            ids[i], ids[j] = new, None
            after[i] = after[j]
            if after[j] != NONE:
                before[after[j]] = i
            if before[i] != NONE:
                offer(before[i])
            offer(i)
        return [x for x in ids if x is not None]

    def _test(self, left: int, right: int) -> bool:
        word, kind = self.text[right]
        if left == self.start:
            return self.brute(word, bool(kind)) == [right]
        if self.merge(left, right) is not None:
            return False  # the pair itself would merge
        return self.brute(self.text[left][0] + word, bool(kind)) == [left, right]

    def fits(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether each pair is the encoding of its concatenation (kept in an open hash table)."""
        key = left.astype(np.int64) * (self.start + 1) + right
        out = np.zeros(len(key), bool)
        todo = np.arange(len(key))
        mask = len(self._keys) - 1
        at = (key * np.int64(0x9E3779B97F4A7C1) >> np.int64(20)) & mask
        missing = []
        while len(todo):
            seen = self._keys[at]
            hit = seen == key[todo]
            out[todo[hit]] = self._fits[at[hit]]
            empty = seen == NONE
            missing.append(todo[empty])
            go = ~(hit | empty)
            todo, at = todo[go], (at[go] + 1) & mask
        lost = np.concatenate(missing) if missing else todo
        if len(lost):
            new, back = np.unique(key[lost], return_inverse=True)
            results = np.fromiter((self._test(*divmod(int(k), self.start + 1)) for k in new), bool, len(new))
            self._put(new, results)
            out[lost] = results[back]
        return out

    def _put(self, keys: np.ndarray, values: np.ndarray) -> None:
        if 2 * (self._held + len(keys)) > len(self._keys):
            old = self._keys != NONE
            keys, values = np.concatenate([self._keys[old], keys]), np.concatenate([self._fits[old], values])
            size = 1 << (4 * len(keys)).bit_length()
            self._keys, self._fits, self._held = np.full(size, NONE, np.int64), np.zeros(size, bool), 0
        mask = len(self._keys) - 1
        slots = (keys * np.int64(0x9E3779B97F4A7C1) >> np.int64(20)) & mask
        for k, v, at in zip(keys.tolist(), values.tolist(), slots.tolist()):
            while self._keys[at] != NONE:
                at = (at + 1) & mask
            self._keys[at], self._fits[at] = k, v
        self._held += len(keys)

    def run(self, words: list[bytes]) -> list[np.ndarray]:
        """Token ids of each word (not empty)."""
        out: list = [None] * len(words)
        for part in self._alike(words):
            last, lengths, _ = self._advance([words[i] for i in part])
            for i, ids in zip(part, self._back(last, lengths)):
                out[i] = ids
        return out

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Token counts of each word (not empty): what its transitions emit, added up."""
        out = np.zeros(len(words), np.int64)
        for part in self._alike(words):
            out[part] = self._advance([words[i] for i in part])[2]
        return out

    def _alike(self, words: list[bytes]):
        """Words of like length go together, within bounded memory."""
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        first = 0
        while first < len(order):
            n = len(words[order[first]])
            last, room = first, max(1, (1 << 22) // max(64, 2 * n))
            while last < len(order) and last - first < room and len(words[order[last]]) <= max(n + 2, n * 9 // 8):
                last += 1
            yield order[first:last]
            first = last

    def _advance(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(last token of each prefix, lengths, tokens of each whole word)."""
        lengths = np.fromiter(map(len, words), np.int32, len(words))
        n = int(lengths.max())
        flat = np.zeros((len(words), n), np.uint8)
        flat[np.arange(n) < lengths[:, None]] = np.frombuffer(b"".join(words), np.uint8)
        last = np.full((len(words), n + 1), NONE, np.int32)
        last[:, 0] = self.start
        now = np.zeros(len(words), np.int32)  # tokens of the prefix read so far
        row = np.arange(0, dtype=np.int32)
        node, left, before = row.copy(), row.copy(), row.copy()
        for i in range(n):
            here = np.nonzero((lengths > i) & (last[:, i] != NONE))[0].astype(np.int32)
            row = np.concatenate([row, here])
            node = np.concatenate([node, np.zeros(len(here), np.int32)])
            left = np.concatenate([left, last[here, i]])
            before = np.concatenate([before, now[here]])
            keep = lengths[row] > i
            row, node, left, before = row[keep], node[keep], left[keep], before[keep]
            node = self.next[node, flat[row, i]]
            keep = node != NONE
            row, node, left, before = row[keep], node[keep], left[keep], before[keep]
            done = lengths[row] == i + 1
            token = np.where(done, self.ends[1][node], self.ends[0][node])
            can = np.nonzero(token != NONE)[0]
            ok = can[self.fits(left[can], token[can])]
            last[row[ok], i + 1] = token[ok]
            now[row[ok]] = before[ok] + 1  # the output of the transition: one token more than the start had
        return last, lengths, now

    def _back(self, last: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
        at = lengths.copy()
        tokens = []
        live = np.arange(len(lengths))
        while len(live):
            t = last[live, at[live]]
            step = np.full(len(lengths), NONE, np.int32)
            step[live] = t
            tokens.append(step)
            at[live] -= self.width[t]
            live = live[at[live] > 0]
        grid = np.stack(tokens[::-1], axis=1) if tokens else np.empty((len(lengths), 0), np.int32)
        return [line[line != NONE] for line in grid]


class CountStates:
    """The transducer's states and transitions by number, made when they are first met.

    State 0 is a word's beginning. A state's starts are (trie node, token
    before, tokens before it less the tokens of the whole prefix).
    """

    def __init__(self, automaton: BpeAutomaton, keep: int = 100_000):
        self.automaton, self.keep = automaton, keep
        self.clear()

    def clear(self) -> None:
        first = ((0, self.automaton.start, 0),)
        self.numbers, self.states = {first: 0}, [first]
        self.moves: dict[int, tuple[int, int]] = {}
        self.finals: dict[int, int] = {}

    def _reach(self, state: int, byte: int, kind: int) -> tuple[list, tuple | None]:
        a = self.automaton
        moved = [(int(a.next[node, byte]), left, less) for node, left, less in self.states[state]]
        moved = [x for x in moved if x[0] != NONE]
        can = [(int(a.ends[kind][node]), left, less) for node, left, less in moved if a.ends[kind][node] != NONE]
        if not can:
            return moved, None
        good = a.fits(np.asarray([c[1] for c in can]), np.asarray([c[0] for c in can]))
        return moved, next((c for c, ok in zip(can, good.tolist()) if ok), None)

    def move(self, state: int, byte: int) -> tuple[int, int]:
        """(next state, tokens emitted) on a byte inside a word."""
        key = state << 8 | byte
        if key not in self.moves:
            moved, hit = self._reach(state, byte, 0)
            if hit is None:  # no token ends here: the byte alone isn't one
                raise ValueError("a symbol is not in the vocabulary")
            emitted = hit[2] + 1
            new = tuple(sorted((node, left, less - emitted) for node, left, less in moved)) + ((0, hit[0], 0),)
            number = self.numbers.get(new)
            if number is None:
                number = self.numbers[new] = len(self.states)
                self.states.append(new)
            self.moves[key] = (number, emitted)
        return self.moves[key]

    def final(self, state: int, byte: int) -> int:
        """Tokens emitted on a word's last byte."""
        key = state << 8 | byte
        if key not in self.finals:
            hit = self._reach(state, byte, 1)[1]
            if hit is None:
                raise ValueError("a symbol is not in the vocabulary")
            self.finals[key] = hit[2] + 1
        return self.finals[key]
