"""N-gram Jaccard self-join by chosen paths.

A document is its set of word shingles; documents with equal sets are one
node. The join works in runs. In a run a node chooses shingles by a hash that
all nodes share (``tokens`` of them on average), and each one begins a path.
Nodes that share a path meet in its bucket:

* a bucket of at most ``small`` nodes compares all their nodes' sketches;
* a larger one first draws ``_LEADERS`` of its nodes and compares all others
  with them. A node within ``reach`` of a leader leaves the bucket as one of
  the leader's own; nodes within ``reach`` plus the linking distance of the
  leader are its guests and are compared with its own. Distances of sketches
  obey the triangle inequality, so a node that leaves loses no link;
* the nodes that stay split: each goes on with those of its sampled shingles
  that a hash of (path, shingle) chooses, ``branch`` of them on average; the
  path and the shingle are a new path, and so on, ``depth`` times;
* what is larger than ``small`` even then is compared in pairs of blocks.

Runs repeat until the target recall. They go in twos, independent of each
other; the share of the nodes linked by the later run that an earlier one has
linked as well estimates what one run finds, and once it reaches ``target`` no
further runs are made.

Sketches (``_HASHES`` minima, two bits each) only decide which nodes are
verified together; the bar lies five standard deviations below the wanted
similarity. Components hold linked sketches alone, no node that merely shares
a bucket or a leader. They are then verified exactly, all pairs of a component
in blocks, by counting common shingles; only link counts and a spanning forest
leave a task, never pairs.

Defined results: a text of fewer words than ``words`` is one shingle of all
its words; null, empty and blank texts have no shingle, link to nothing and
are classes of their own; a null doc_id ranks above all others (so does the id
2^63 - 1, which comes back null); repeated rows link to each other; an empty
table gives no rows; further columns are ignored by :func:`jaccard_join` and
passed on by :func:`keep_one`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import arrow_map, fresh_prefix, id_text, maybe_in, shuffle_parts, stored, stored_map, text_slices
from .word_hashes import hashes, mix, rolling, words_of

HIGHEST = 2**63 - 1
_HASHES = 256
#: Nodes of a hot bucket that a round compares all others with.
_LEADERS = 16
#: Unequal minima up to which a node may be joined to a leader; unrelated sets differ in 192 of 256.
_WIDEST = 144
#: Shingles that a block of a component holds on average at most.
_MOST_SHINGLES = 400_000
_MULTIPLY = (np.random.default_rng(7).integers(0, 2**63, _HASHES, np.uint64) << np.uint64(1)) | np.uint64(1)
_ADD = np.random.default_rng(8).integers(0, 2**63, _HASHES, np.uint64)


def shingles(text: str, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    found = words_of(text)
    if not found:
        return np.empty(0, np.uint64)
    return np.unique(rolling(hashes(found), min(words, len(found))) + np.uint64(min(words, len(found))))


def sketch(items: np.ndarray) -> bytes:
    """Two bits of each of the minima of ``_HASHES`` hash functions."""
    least = np.full(_HASHES, ~np.uint64(0))
    for at in range(0, len(items), 4096):  # a long text takes no more memory than a short one
        part = items[at : at + 4096]
        for k in range(0, _HASHES, 32):
            h = part[None, :] * _MULTIPLY[k : k + 32, None]
            h += _ADD[k : k + 32, None]
            np.minimum(least[k : k + 32], h.min(axis=1), out=least[k : k + 32])
    two = mix(least) & np.uint64(3)
    bits = np.stack([two & np.uint64(1), two >> np.uint64(1)], 1).astype(np.uint8).ravel()
    return np.packbits(bits).tobytes()


#: Pairs of runs that the sampled shingles of a node suffice for.
_MOST_TURNS = 3


def _describe(words: int, tokens: int):
    """Node, size, sketch, sampled shingles (``paths``; the last bit tells the run of two) and the pair of runs that each begins in (``turns``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole):
                nodes, sizes, sketches, paths, turns = [], [], [], [], []
                for text in batch.column("text").to_pylist():
                    s = shingles(text, words)
                    sizes.append(len(s))
                    if not len(s):
                        nodes.append(None)
                        sketches.append(None)
                        paths.append([])
                        turns.append([])
                        continue
                    nodes.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    sketches.append(sketch(s))
                    h = mix(s + np.uint64(0x51ED2701))
                    turn = h.astype(np.float64) * (len(s) / 2.0**65 / tokens)
                    mine = turn < _MOST_TURNS
                    order = np.argsort(h[mine])
                    paths.append(h[mine][order].view(np.int64))
                    turns.append(turn[mine][order].astype(np.int8))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc"), batch.column("th"), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int32()), pa.array(sketches, pa.binary()), pa.array(paths, pa.list_(pa.int64())), pa.array(turns, pa.list_(pa.int8()))],
                    ["doc", "th", "node", "size", "sketch", "paths", "turns"],
                )

    return run


def _forest(close: np.ndarray) -> np.ndarray:
    """Least row of each row's component under the symmetric relation ``close``."""
    n = len(close)
    root = np.arange(n)
    while True:
        new = np.minimum(root, np.where(close, root[None, :], n).min(axis=1))
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal keys, across batches."""
    held: list[pa.RecordBatch] = []
    at = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.nonzero(change)[0].tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(c[a] for c in columns)
            if at is not None and key != at:
                yield pa.Table.from_batches(held)
                held = []
            at = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _link_bar(similarity: float) -> float:
    """Equal minima that two sketches must show to be linked."""
    share = (1 + 3 * similarity) / 4
    return _HASHES * share - 5 * (_HASHES * share * (1 - share)) ** 0.5


def _codes(sketches: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(sketches.to_pylist()), np.uint64).reshape(-1, _HASHES // 32)


def _differ(x: np.ndarray) -> np.ndarray:
    """Number of unequal minima, from the exclusive or of codes."""
    return np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555))


_OWN, _GUEST, _STAYS = 1, 2, 3


def _joined_leaders(path: np.ndarray, row: np.ndarray, place: np.ndarray, link: np.ndarray) -> np.ndarray:
    """For each row, the least place of the leaders that links of rows here join to each of its path's leaders.

    A leader is a row of its bucket too, and every row within the linking
    distance of two leaders joins them.
    """
    buckets, of = np.unique(path, return_inverse=True)
    joined = np.tile(np.arange(_LEADERS), (len(buckets), 1))
    near = np.zeros((len(path), _LEADERS), bool)
    near[row[link], place[link]] = True
    while True:
        least = np.where(near, joined[of], _LEADERS).min(axis=1)
        new = joined.copy()
        rows, places = np.nonzero(near)
        np.minimum.at(new, (of[rows], places), least[rows])
        new = np.minimum(new, np.take_along_axis(new, new, 1))
        if (new == joined).all():
            return joined[of]
        joined = new


def _to_leaders(similarity: float, guests: bool):
    """What nodes of a bucket are to its leaders: (node, path, sketch, leader, kind); kind null: a link.

    Without ``guests``: links, who leaves with which leader, and who stays.
    With them, the leaders being those that others left with: who left, and
    the guests.
    """
    far = _HASHES - _link_bar(similarity)
    reach = min(far, max(0.0, _WIDEST - far))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            leaders = batch.column("leaders")
            offsets = leaders.offsets.to_numpy() - leaders.offsets[0].as_py()
            row = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            place = np.arange(len(row)) - offsets[row]
            flat = leaders.flatten()
            names = flat.field("node")
            mine, theirs = _codes(batch.column("sketch")), _codes(flat.field("sketch"))
            apart = np.zeros(len(row), np.int64)
            for k in range(mine.shape[1]):
                apart += _differ(mine[row, k] ^ theirs[:, k])
            near = np.nonzero(apart <= reach)[0]
            _, first = np.unique(row[near], return_index=True)
            own = near[first]
            own_of = np.full(batch.num_rows, -1)
            own_of[row[own]] = own
            leaves = own_of >= 0
            if guests:
                within = np.nonzero(apart <= reach + far)[0]
                guest = within[~leaves[row[within]]]
                # a node that leaves with one leader is a guest of the earlier ones that it is near, unless links join the two leaders
                more = within[leaves[row[within]]]
                more = more[place[more] < place[own_of[row[more]]]]
                joined = _joined_leaders(batch.column("path").to_numpy(), row, place, apart <= far)
                more = more[joined[row[more], place[more]] != joined[row[more], place[own_of[row[more]]]]]
                at, leader = row[np.concatenate([own, guest, more])], np.concatenate([own, guest, more])
                kind = np.repeat([_OWN, _GUEST], [len(own), len(guest) + len(more)])
            else:
                other = np.asarray(pc.not_equal(batch.column("node").take(pa.array(row)), names))
                link = np.nonzero((apart <= far) & other)[0]
                stays = np.nonzero(~leaves)[0]
                at = np.concatenate([row[link], row[own], stays])
                leader = np.concatenate([link, own, np.full(len(stays), -1)])
                kind = np.repeat([0, _OWN, _STAYS], [len(link), len(own), len(stays)])
            took = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("node").take(took), batch.column("path").take(took), batch.column("sketch").take(took), names.take(pa.array(leader, pa.int64(), mask=leader < 0)), pa.array(kind, pa.int8(), mask=kind == 0)],
                ["node", "path", "sketch", "leader", "kind"],
            )

    return run


def _guest_links(similarity: float):
    """A link of each guest to one of the leader's own, if any is near enough; block by block."""
    far = _HASHES - _link_bar(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["path", "leader", "i", "j"]):
            kind = group.column("kind").to_numpy()
            nodes, codes = group.column("node").combine_chunks(), _codes(group.column("sketch").combine_chunks())
            own, guests = np.nonzero(kind == _OWN)[0], np.nonzero(kind == _GUEST)[0]
            if not len(own) or not len(guests):
                continue
            left, right = [], []
            for at in range(0, len(guests), 256):
                some = guests[at : at + 256]
                apart = np.zeros((len(some), len(own)), np.int32)
                for k in range(codes.shape[1]):
                    apart += _differ(codes[some, k][:, None] ^ codes[own, k][None, :])
                best = apart.argmin(axis=1)
                good = np.nonzero(apart[np.arange(len(some)), best] <= far)[0]
                left.append(some[good])
                right.append(own[best[good]])
            found = [nodes.take(pa.array(np.concatenate(x))) for x in (left, right)]
            late = bool(group.column("path")[0].as_py() & 1)
            yield pa.RecordBatch.from_arrays([*found, pa.array([late] * len(found[0]), pa.bool_())], ["a", "b", "late"])

    return run


def _only(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """Hardly more of ``nodes`` than ``rows`` name: what a join would move for nothing stays where it is."""
    node_hash = F.xxhash64("node")
    return maybe_in(nodes, node_hash, rows.select("node").distinct(), node_hash)


_WIDE, _FEW = 1024, 4096
_LINK = "a binary, b binary, late boolean"


def _late() -> Column:
    """Whether a row's path is of the later run of two."""
    return F.pmod("path", F.lit(2)) == 1


def _dealt(rows: DataFrame, keys: list[str], left: Column, right: Column) -> DataFrame:
    """``rows`` of groups: those of ``left`` in blocks against those of ``right`` in blocks, under keys (i, j)."""
    count = lambda c: F.ceil(F.sum(c.cast("int")) / _WIDE).cast("int")
    blocks = stored(rows.groupBy(*keys).agg(count(left).alias("n_i"), count(right).alias("n_j")).filter("n_i > 0 AND n_j > 0"), small=True)
    rows = rows.join(blocks, keys)
    at = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    pair = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    mine = F.transform(F.sequence(F.lit(0), F.col("n_j") - 1), lambda j: pair(at("n_i"), j))
    theirs = F.transform(F.sequence(F.lit(0), F.col("n_i") - 1), lambda i: pair(i, at("n_j")))
    return rows.withColumn("p", F.explode(F.when(left, mine).otherwise(theirs))).select("*", "p.i", "p.j").drop("p", "n_i", "n_j")


def _split(hot: DataFrame, nodes: DataFrame, similarity: float, small: int, depth: int, branch: float, expected: int) -> tuple[list[DataFrame], DataFrame]:
    """Edge tables, and the rows (node, path, n) of the buckets that are to be compared whole."""
    parts = shuffle_parts(hot.sparkSession)
    edges: list[DataFrame] = []
    done: list[DataFrame] = []
    live = hot
    nodes = stored(_only(nodes.select("node", "sketch", "paths"), hot)) if hot.limit(1).count() else nodes
    for level in range(depth):
        large = live.filter(F.col("n") > small)
        if large.limit(1).count() == 0:
            break
        done.append(live.filter(F.col("n") <= small))
        rows = stored(large.select("node", "path").join(nodes.select("node", "sketch"), "node"))
        order = F.xxhash64("node", F.lit(level))
        drawn = rows.groupBy("path", F.pmod(order, F.lit(_LEADERS)).alias("slot")).agg(F.min(F.struct(order.alias("o"), "node", "sketch")).alias("x"))
        drawn = stored(drawn.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("x.node", "x.sketch"))).alias("leaders")), small=True)
        if drawn.count() <= _FEW:  # some 1.5 kB each
            drawn = F.broadcast(drawn)
        compared = "node binary, path long, sketch binary, leader binary, kind tinyint"
        found = stored_map(rows.join(drawn, "path").select("node", "path", "sketch", "leaders"), _to_leaders(similarity, False), compared)
        edges.append(found.filter("kind IS NULL").select(F.col("node").alias("a"), F.col("leader").alias("b"), _late().alias("late")))
        followed = found.filter(F.col("kind") == _OWN).groupBy("path", "leader").agg(F.count("*").alias("n")).filter("n > 1")
        followed = followed.groupBy("path").agg(F.collect_set("leader").alias("followed"))
        led = drawn.join(followed, "path").select("path", F.expr("filter(leaders, x -> array_contains(followed, x.node)) AS leaders"))
        led = stored(led, small=True)
        if led.count() <= _FEW:
            led = F.broadcast(led)
        near = stored_map(rows.join(led, "path").select("node", "path", "sketch", "leaders"), _to_leaders(similarity, True), compared)
        groups = _dealt(near, ["path", "leader"], F.col("kind") == _OWN, F.col("kind") == _GUEST)
        groups = groups.repartition(parts, "path", "leader", "i", "j").sortWithinPartitions("path", "leader", "i", "j")
        edges.append(stored_map(groups, _guest_links(similarity), _LINK))
        stays = found.filter(F.col("kind") == _STAYS).select("node", "path").join(nodes.select("node", "paths"), "node")
        bar = int(2.0**63 * min(1.0, branch / expected))
        chosen = F.filter(F.transform("paths", lambda t: F.xxhash64("path", t)), lambda h: F.abs(h) < bar)
        same_run = F.transform(chosen, lambda h: h - F.pmod(h, F.lit(2)) + F.pmod(F.col("path"), F.lit(2)))
        new = stored(stays.select("node", F.explode(same_run).alias("path")))
        shared = stored(new.groupBy("path").agg(F.count("*").alias("n")).filter("n > 1"), small=True)
        live = stored(new.join(shared, "path").select("node", "path", "n"))
    for part in done:
        live = live.unionByName(part)
    return edges, live


def _sketch_links(similarity: float):
    bar = _link_bar(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right, late = [], [], []

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary()), pa.array(late, pa.bool_())], ["a", "b", "late"])

        for group in _groups(batches, ["path", "i", "j"]):
            if group.num_rows < 2:
                continue
            nodes = np.asarray(group.column("node").to_pylist(), object)
            order = np.argsort(nodes)
            nodes = nodes[order]
            first = np.concatenate([[True], nodes[1:] != nodes[:-1]])
            order, nodes = order[first], nodes[first]
            if len(nodes) < 2:
                continue
            size = group.column("size").to_numpy()[order].astype(np.int64)
            codes = _codes(group.column("sketch"))[order]
            differ = np.zeros((len(nodes), len(nodes)), np.int32)
            for k in range(codes.shape[1]):
                differ += _differ(codes[:, k][:, None] ^ codes[:, k][None, :])
            close = (_HASHES - differ >= bar) & (np.minimum(size[:, None], size[None, :]) >= similarity * np.maximum(size[:, None], size[None, :]) - 1e-9)
            root = _forest(close)
            mine = np.nonzero(root != np.arange(len(root)))[0]
            left += nodes[mine].tolist()
            right += nodes[root[mine]].tolist()
            late += [bool(group.column("path")[0].as_py() & 1)] * len(mine)
            if len(left) > 20_000:
                yield made()
                left, right, late = [], [], []
        if left:
            yield made()

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole):
                sets = [shingles(t, words).tobytes() for t in batch.column("text").to_pylist()]
                rest = ["root", "node", "copies", "block", "blocks"]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(sets, pa.binary())], [*rest, "items"])

    return run


def common_counts(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of incidence blocks."""
    n = len(sets)
    sizes = np.fromiter(map(len, sets), np.int64, n)
    row = np.repeat(np.arange(n), sizes)
    items, column, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.where(seen > 1, np.cumsum(seen > 1) - 1, -1)
    column = number[column]
    keep = column >= 0
    row, column = row[keep], column[keep]
    out = np.zeros((n, n), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    last = int(column[-1]) + 1 if len(column) else 0
    for at in range(0, last, columns):
        a, b = np.searchsorted(column, [at, at + columns])
        block = np.zeros((n, columns), np.float32)
        block[row[a:b], column[a:b] - at] = 1
        out += block @ block.T
    out = out.astype(np.int64)
    np.fill_diagonal(out, sizes)
    return out


def _verify(similarity: float):
    """Exact links of a component, or of a pair of its blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["root", "i", "j"]):
            i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
            nodes = group.column("node").to_pylist()
            sets = [np.frombuffer(x, np.uint64) for x in group.column("items").to_pylist()]
            size = np.fromiter(map(len, sets), np.int64, len(sets))
            common = common_counts(sets)
            union = size[:, None] + size[None, :] - common
            close = common >= similarity * union - 1e-9
            np.fill_diagonal(close, False)
            if i != j:
                block = group.column("block").to_numpy()
                close &= block[:, None] != block[None, :]
            links = close @ group.column("copies").to_numpy()
            order = np.argsort(np.asarray(nodes, object))
            root = np.empty(len(nodes), np.int64)
            root[order] = order[_forest(close[order][:, order])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes, pa.binary()), pa.array([nodes[r] for r in root], pa.binary()), pa.array(links.astype(np.int64))], ["a", "b", "links"]
            )

    return run


def _pairs(blocks: str, block: str) -> Column:
    """Keys (i <= j) of all pairs of blocks that hold ``block``."""
    return F.expr(f"transform(sequence(0, {blocks} - 1), k -> struct(least(k, {block}) AS i, greatest(k, {block}) AS j))")


def _run_links(nodes: DataFrame, turn: int, similarity: float, tokens: int, small: int, block: int, depth: int, branch: float) -> DataFrame:
    """The sketch links (a, b, late) that two runs find: spanning forests of their buckets."""
    parts = shuffle_parts(nodes.sparkSession)
    begins = F.transform(F.filter(F.arrays_zip("paths", "turns"), lambda x: x["turns"] == turn), lambda x: x["paths"])
    chosen = nodes.select("node", F.explode(begins).alias("path"))
    shared = stored(chosen.groupBy("path").agg(F.count("*").alias("n")).filter("n > 1"), small=True)
    path_hash = F.xxhash64("path")
    met = stored(maybe_in(chosen, path_hash, shared, path_hash).join(shared, "path").select("node", "path", "n"))
    led, rows = _split(met.filter(F.col("n") > small), nodes, similarity, small, depth, branch, 2 * tokens * _MOST_TURNS)
    rows = rows.unionByName(met.filter(F.col("n") <= small))
    rows = rows.withColumn("blocks", F.when(F.col("n") <= small, 1).otherwise(F.ceil(F.col("n") / (block * 2))).cast("int"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.select("node", "path", F.explode(_pairs("blocks", "block")).alias("p")).select("node", "path", "p.i", "p.j")
    buckets = rows.join(_only(nodes.select("node", "size", "sketch"), rows), "node").repartition(parts, "path", "i", "j").sortWithinPartitions("path", "i", "j")
    return reduce(DataFrame.unionByName, led, stored_map(buckets, _sketch_links(similarity), _LINK))


def linked_share(links: DataFrame) -> float:
    """Share of the nodes that the late links hold which others hold too: what the runs before find of them."""
    ends = links.select(F.explode(F.array("a", "b")).alias("node"), "late")
    seen = ends.groupBy("node").agg(F.max("late").alias("late"), F.min("late").alias("both"))
    late, known = seen.filter("late").agg(F.count("*"), F.sum((~F.col("both")).cast("int"))).first()
    return 1.0 if not late else known / late


def _classes(docs: DataFrame, words: int = 5, similarity: float = 0.8, tokens: int = 6, small: int = 128, block: int = 256, depth: int = 3, branch: float = 1.5, target: float = 0.99, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, th, root (null: no shingles), class, n_links, class_size: a row per document."""
    spark = docs.sparkSession
    parts = shuffle_parts(spark)
    rows = id_text(docs, id_col, text_col).select(F.coalesce("doc_id", F.lit(HIGHEST)).alias("doc"), F.xxhash64("text").alias("th"), "text")
    kinds = "doc long, th long, node binary, size int, sketch binary, paths array<long>, turns array<tinyint>"
    seen = stored_map(rows, _describe(words, tokens), kinds)
    nodes = stored(
        seen.filter("node IS NOT NULL").groupBy("node").agg(
            F.min(F.struct("doc", "th", "size", "sketch", "paths", "turns")).alias("x"), F.count("*").alias("copies")
        ).select("node", "copies", "x.*")
    )

    links = None
    for turn in range(_MOST_TURNS):
        new = _run_links(nodes, turn, similarity, tokens, small, block, depth, branch)
        links = new if links is None else links.withColumn("late", F.lit(False)).unionByName(new)
        if linked_share(links) >= target:
            break
    near = components(links.select("a", "b"))

    roots = near.select(F.col("a").alias("node"), "root")
    roots = stored(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()).join(nodes.select("node", "doc", "th", "copies", "size"), "node"))
    weight = F.greatest(F.count("*") / block, F.sum("size") / _MOST_SHINGLES)
    sizes = stored(roots.groupBy("root").agg(F.ceil(weight).cast("int").alias("blocks")), small=True)  # a join of two plain shuffles: a large component is split there
    placed = stored(roots.drop("size").join(sizes, "root").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")))
    key_hash = F.xxhash64("doc", "th")
    texts = maybe_in(rows, key_hash, placed, key_hash).join(placed, ["doc", "th"])
    items = arrow_map(
        texts.select("text", "root", "node", "copies", "block", "blocks"), _sets(words), "root binary, node binary, copies long, block int, blocks int, items binary"
    )
    items = items.dropDuplicates(["node"])  # rows repeated with the same doc_id and text
    dealt = items.withColumn("p", F.explode(_pairs("blocks", "block"))).select("root", "node", "copies", "block", "items", "p.i", "p.j")
    dealt = dealt.repartition(parts, "root", "i", "j").sortWithinPartitions("root", "i", "j")
    exact = stored_map(dealt, _verify(similarity), "a binary, b binary, links long")

    classes = components(exact.select("a", "b"))
    links = exact.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    info = nodes.select("node", "doc", "copies").join(classes.withColumnRenamed("a", "node"), "node", "left").join(links, "node", "left")
    info = stored(info.withColumn("root", F.coalesce("root", "node")))
    whole = stored(info.groupBy("root").agg(F.min("doc").alias("class"), F.sum("copies").alias("class_size")))
    info = info.join(whole, "root").select("node", "root", "class", "class_size", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return seen.select("doc", "th", "node").join(info, "node", "left")


def jaccard_join(docs: DataFrame, **options) -> DataFrame:
    """doc_id, class_id (least doc_id linked to it by a chain), n_links (documents of the similarity or more), class_size.

    ``options`` as for :func:`_classes`.
    """
    return _classes(docs, **options).select(
        F.nullif("doc", F.lit(HIGHEST)).alias("doc_id"),
        F.nullif(F.coalesce("class", "doc"), F.lit(HIGHEST)).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
    )


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One row of ``docs`` (all columns) of each class: that of the least doc_id. Rows without shingles all stay."""
    own = fresh_prefix(docs.columns)
    key, text_hash = f"{own}_id", f"{own}_th"
    kept = _classes(docs, **options).filter("root IS NOT NULL").groupBy("root").agg(F.min(F.struct("doc", "th")).alias("x")).select(F.col("x.doc").alias(key), F.col("x.th").alias(text_hash))
    words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rows = docs.filter(words).withColumns({key: F.coalesce(F.col("doc_id").cast("long"), F.lit(HIGHEST)), text_hash: F.xxhash64("text")})
    one = rows.join(kept, [key, text_hash], "left_semi").dropDuplicates([key, text_hash])
    return one.drop(key, text_hash).unionByName(docs.filter(~words))
