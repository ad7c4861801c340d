"""Odd, empty, very long, hot and clashing inputs, through Spark, against libraries and plain computations."""

import hashlib
import math
import random
import re
import struct
import zlib
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest

from wavelattice.llm import exact_dedup, jaccard_join, packing, piece_fst, secrets, substring_dedup, tiff, token_counts, toxicity, warc

CLASH = "doc_id long, text string, __text string, __id long, __own_id string, __at string, bucket string, root string, n_chars int"
BITS = ["<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "<unk>", "<0x0A>", "\u2581", "'s", "'re", "'LL", "\ufb01", "\ufb00", "e\u0301", "\u00e9", "\u0301", "\u0130", "\u00df", "\u1e9e", "\u03a3\u03c2", "\u4e2d\u6587", "\ud55c\uad6d", "\u1112\u1161\u11ab", "\u0939\u093f", "\u0639\u0631", "\u0e44\u0e17", "\U0001f642", "\U0001f44d\U0001f3fd", "\u200d", "\u200b", "\u00a0", "\u3000", "\x85", "\t", "\n", "  ", " ", "a", "The", "123", "\u0663", "\u00bd", "_", "--", "...", "''", '"', "x" * 50, "\u0915\u093c", "\u0958", "\ufeff", "\u2028"]


def odd_texts(n, seed=3):
    rng = random.Random(seed)
    mixed = ["".join(rng.choice(BITS) for _ in range(rng.randrange(1, 30))) for _ in range(n)]
    unbroken = ["x" * 70_000, "\u4e2d" * 5_000, "a1" * 5_000, "ab'" * 3_000, "!?" * 5_000, "\u0130" * 900, "e\u0301" * 900, "<|endoftext|>" * 300, "'" * 3_000, "x" * 30_000 + " " + "y" * 30_000]
    return [None, "", *mixed, *unbroken]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "mine", -i, "own", "at", "b", "r", 7) for i, t in enumerate(texts)], CLASH).repartition(3)


def test_token_counts_through_spark(spark):
    from tokenizers import Tokenizer

    path, some = public_tokenizers.path("word_bpe_49k.json"), odd_texts(300)
    rules = Tokenizer.from_file(path)
    want = {i: len(rules.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(some)}
    for chunk in (1 << 16, 40):
        found = token_counts.count_tokens(frame(spark, some), path, chunk_chars=chunk).collect()
        assert {r.doc_id: r.n_tokens for r in found} == want
    assert all(r.n_bytes == len((some[r.doc_id] or "").encode()) and r.over_limit == (r.n_tokens > 2048) for r in found)


def test_state_maps_complete_themselves():
    machine = token_counts.tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    word = "internationalization" * 40
    cut = token_counts.chunks_of(machine, word, 100)
    assert len(cut) > 5 and all(kind == token_counts.LETTERS for _, kind in cut[1:])
    maps = [token_counts._compile(machine, c, kind, token_counts.LETTERS if k + 1 < len(cut) else token_counts.BETWEEN, "zq" if k else "") for k, (c, kind) in enumerate(cut)]
    before = [len(m.table) for m in maps]
    state, n = token_counts.scan(maps)[-1](None)
    assert n + token_counts.close(machine.states, state) == machine.counts([word])[0]
    assert sum(len(m.table) for m in maps) > sum(before)  # the guesses were wrong, and entries were added


def test_ids_and_pieces_through_spark(spark):
    import sentencepiece
    from tokenizers import Tokenizer

    some = odd_texts(200, 5)
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    found = piece_fst.encode_decode(frame(spark, some), public_tokenizers.path("piece_bpe_32k.model"), with_ids=True).collect()
    for r in found:
        ids = library.encode(some[r.doc_id] or "")
        assert r.ids == ids and r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    rules = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces: dict = {}
    for r in packing.pack(frame(spark, some), public_tokenizers.path("byte_bpe_50k.json")).collect():
        pieces.setdefault(r.doc_id, []).append(r)
    for i, t in enumerate(some):
        ids, at = [*rules.encode(t or "", add_special_tokens=False).ids, 2], 0
        for k, r in enumerate(sorted(pieces[i], key=lambda r: r.piece)):
            part = ids[at : at + r.length]
            assert (r.piece, r.start, r.ids_crc32) == (k, at, zlib.crc32(struct.pack(f"<{len(part)}I", *part)))
            at += r.length
        assert at == len(ids)


def _varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(number, value):
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def _double_array(pairs):
    """A character map as the file format has it: units by breadth, values in a pool."""
    pool, starts = b"", {}
    for value in sorted(set(pairs.values())):
        starts[value] = len(pool)
        pool += value.encode() + b"\0"
    keys = {k.encode(): starts[v] for k, v in pairs.items()}
    units, base = {0: 0}, 256

    def place(at, prefix):
        nonlocal base
        nexts = sorted({k[len(prefix)] for k in keys if k.startswith(prefix) and len(k) > len(prefix)})
        mine = base
        base += 256
        units[at] = units.get(at, 0) | (at ^ mine) << 10 if at else mine << 10
        if prefix in keys:
            units[at] |= 1 << 8
            units[mine] = keys[prefix] | 1 << 31
        for byte in nexts:
            units[mine ^ byte] = byte
            place(mine ^ byte, prefix + bytes([byte]))

    place(0, b"")
    table = b"".join(struct.pack("<I", units.get(i, 0)) for i in range(base))
    return struct.pack("<I", len(table)) + table + pool


@pytest.mark.parametrize("squeeze, prefix, with_bytes", [(1, 1, True), (0, 1, False), (1, 0, False), (0, 0, True)])
def test_unigram_models_equal_the_library(tmp_path, squeeze, prefix, with_bytes):
    import sentencepiece

    rng = random.Random(4)
    words = ["\u2581", "a", "b", "c", "ab", "bc", "abc", "\u2581a", "\u2581ab", "cab", "ca", "\u2581\u2581", "e", "\u4e2d"]
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((w, -rng.random() * 9 - 1, 1) for w in words), ("bab", 0.0, 4), ("cc", -1.0, 5)]
    pieces += [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)] if with_bytes else []
    charsmap = _double_array({"\uff41": "a", "\u00e9": "e", "\u3000": " ", "xy": "b", "x": "c"})
    data = b"".join(_field(1, _field(1, p.encode()) + _field(2, s) + _field(3, k)) for p, s, k in pieces)
    data += _field(2, _field(3, 1) + _field(35, int(with_bytes)))
    data += _field(3, _field(1, b"own") + _field(2, charsmap) + _field(3, prefix) + _field(4, squeeze) + _field(5, 1))
    path = tmp_path / "own.model"
    path.write_bytes(data)
    library = sentencepiece.SentencePieceProcessor(model_proto=data)
    machine = piece_fst.PieceTransducer(piece_fst.read_model(str(path)))
    some = ["", " ", "abc", "  a  b ", "xyx\uff41\u3000\u00e9", "zzz ab", "bab\u4e2d\u4e2d\u9fff", "ccc", "a" * 300, "\U0001f642 ab"]
    some += ["".join(rng.choice("abcxy e\uff41\u00e9\u4e2d\u3000z ") for _ in range(rng.randrange(40))) for _ in range(300)]
    found = machine.encode(some)
    assert [x.tolist() for x in found] == [library.encode(t) for t in some]
    assert [machine.decode(x) for x in found] == [library.decode(x.tolist()) for x in found]


def plain_features(lexicon, text):
    """Every entry and exception looked for by itself, from left to right."""
    folded = toxicity.fold(text)
    at = lambda phrase: [m.start() for m in re.finditer(f"(?={re.escape(phrase)})", folded)]
    safe = [(a, a + len(p)) for p in map(toxicity.fold, toxicity.EXCEPTIONS) for a in at(p)]
    total = sum(w for e, w in lexicon.weights.items() for a in at(e) if not any(x <= a and a + len(e) <= y for x, y in safe))
    return total, len(folded.split())


def test_toxicity_equals_a_plain_scan(spark):
    folder = "/root/testdata/sf0.01"
    data, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    lexicon = toxicity.fit(data, labels)
    assert lexicon.weights
    texts = {r.doc_id: r.text or "" for r in data.limit(300).collect()}
    texts |= {10**9: "", 10**9 + 1: "trash can and class clown", 10**9 + 2: "TR4SH " * 5000, 10**9 + 3: "TR4SH " * 5000}
    rows = frame(spark, []).select("doc_id", "text").unionByName(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    found = {r.doc_id: r for r in toxicity.score(rows, lexicon).collect()}
    bias, a, b = lexicon.curve
    for i, t in texts.items():
        total, n = plain_features(lexicon, t)
        want = 1 / (1 + math.exp(-max(-30.0, min(30.0, bias + a * total**0.5 + b * total / max(1, n)))))
        assert found[i].score == pytest.approx(want, abs=1e-9) and found[i].predicted == (found[i].score >= 0.5)
        assert found[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
    assert found[10**9 + 2].score == found[10**9 + 3].score


def test_cover_takes_what_explains_most():
    entries = [" aaaa", " aaaab", " zz "]
    assert toxicity.cover(entries, [1.0, 1.0, 1.0], [[0, 1], [0, 1], [0, 1, 2], [2]], 1, 9, 1) == [" aaaab", " zz "]


def plain_spans(text):
    kinds = [(secrets.ASSIGN, 8), (secrets.ACCESS, 0), (secrets.HEX, 0)]
    base = [(m.start(), k, m.end()) for k, (p, keep) in enumerate(kinds) for m in re.finditer(p, text) if not keep or len(m.group(2)) >= keep]
    found = []
    for m in re.finditer(secrets.CANDIDATE, text):
        word = m.group()
        if any(a < m.end() and m.start() < b for a, _, b in base) or not re.search("[0-9]", word) or not re.search("[A-Za-z]", word) or re.search(secrets.ALLOWED, word):
            continue
        chars, window, bits = next(c for c in secrets.CLASSES.values() if re.fullmatch(c[0], word))
        peak = max((-sum(p * math.log2(p) for p in (part.count(c) / window for c in set(part))) for part in (word[i : i + window] for i in range(len(word) - window + 1))), default=0)
        if peak >= bits - 1e-9:
            found.append((m.start(), 3, m.end()))
    return sorted(base), sorted(base + found)


def secret_texts(n):
    rng = random.Random(8)
    bits = ["API_KEY = 'abcd1234'", "token:", "AKIA" + "Q7" * 8, "0f" * 20, "q9Zr7Lk2Vx8Tb4Nw6Yc1Pd3Hs5", "\U0001f642", " ", "\n", "x" * 25, "deadbeef" * 3, "ab12" * 9, "sample-q9Zr7Lk2Vx8Tb4Nw6Yc1", "=", "/", "e\u0301 "]
    rows = ["".join(rng.choice(bits) for _ in range(rng.randrange(20))) for _ in range(n)]
    return [None, "", *rows, "q9Zr7Lk2Vx8Tb4Nw6Yc1 AKIAQ7Q7Q7Q7Q7Q7Q7 " * 4000, "q9Zr7Lk2Vx8Tb4Nw6Yc1" * 2000]


def test_secrets_equal_a_plain_scan(spark):
    some = secret_texts(200)
    shown = lambda spans: ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans)
    df = frame(spark, some)
    for r in secrets.scan(df).collect():
        base, every = plain_spans(some[r.doc_id] or "")
        assert r.spans == shown(every) and r.base_sha256 == hashlib.sha256(shown(base).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[1] == k for s in base) for k in range(3))
    clean = secrets.redact(df)
    assert clean.columns == df.columns
    for r in clean.collect():
        text = some[r.doc_id]
        at, parts = 0, []
        for a, k, b in plain_spans(text or "")[1]:
            if a >= at:
                parts += [text[at:a], f"[{secrets.KINDS[k].upper()}]"]
            at = max(at, b)
        assert r.text == (text if not parts else "".join(parts) + text[at:])
        assert (r["__text"], r["__at"], r.n_chars) == ("mine", "at", 7 if not parts else len(r.text))


def words_kept(rows, size):
    split = {i: substring_dedup.words_of(t or "") for i, t in rows}
    first = {}
    for i, _ in sorted(rows, key=lambda r: r[0]):
        for k in range(len(split[i]) - size + 1):
            first.setdefault(tuple(split[i][k : k + size]), i)
    out = {}
    for i, w in split.items():
        gone = {p for k in range(len(w) - size + 1) if first[tuple(w[k : k + size])] != i for p in range(k, k + size)}
        out[i] = (len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone))
    return out


def repetitive_rows(n):
    rng = random.Random(2)
    passage = [f"p{rng.randrange(30)}" for _ in range(60)]
    rows = []
    for i in range(n):
        own = [f"w{rng.randrange(40)}" for _ in range(rng.randrange(60))]
        at = rng.randrange(40)
        rows.append((i, " ".join(own[:20] + passage[at : at + rng.randrange(40)] + own[20:] + (own[:20] if i % 5 == 0 else []))))
    return rows


def test_substring_index_compacts_verifies_and_goes_on(spark):
    rows = repetitive_rows(80)
    want = words_kept(rows, 12)
    table = lambda some: spark.createDataFrame(some, "doc_id long, text string")
    check = lambda found: [((r.n_words, r.n_removed, r.kept_sha256), (want[r.doc_id][0], want[r.doc_id][1], hashlib.sha256(want[r.doc_id][2].encode()).hexdigest())) for r in found]
    index = substring_dedup.FingerprintIndex()
    found = substring_dedup.dedup_substrings(table(rows), size=12, anchor=3, index=index).collect()
    assert len(found) == 80 and all(a == b for a, b in check(found))
    assert index.compactions == 1 and len(index.runs) == 2
    assert index.entries().count() == index.entries().select("m", "d").distinct().count()
    # one bit of a word's hash: unlike words' minimisers meet all over, digests of the words decide
    found = substring_dedup.dedup_substrings(table(rows), size=12, anchor=3, hash_bits=1).collect()
    assert all(a == b for a, b in check(found))
    # a second part of the corpus is settled against the first one's index
    index = substring_dedup.FingerprintIndex()
    first = substring_dedup.dedup_substrings(table(rows[:50]), size=12, anchor=3, batches=2, index=index)
    later = substring_dedup.dedup_substrings(table(rows[50:]), size=12, anchor=3, batches=1, index=substring_dedup.FingerprintIndex(runs=index.runs), history=table(rows[:50]))
    assert all(a == b for a, b in check(later.collect()))
    assert first.count() == 50 and substring_dedup.dedup_substrings(table(rows).limit(0)).count() == 0


def links_of(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        k = min(5, len(w))
        sets[i] = {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if w else set()
    return {(a, b) for a, b in combinations(sorted(sets), 2) if sets[a] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])}


def hot_rows():
    """One large group of near copies of many degrees, and one passage that unlike texts share."""
    rng = random.Random(9)
    base = [f"v{rng.randrange(3000)}" for _ in range(150)]
    rows = []
    for i in range(260):
        words = list(base)
        for _ in range(rng.randrange(0, 9)):
            words[rng.randrange(len(words))] = f"e{i}x{rng.randrange(99)}"
        rows.append((i, " ".join(words)))
    rows += [(300 + i, " ".join(base[:60] + [f"u{i}y{k}" for k in range(60)])) for i in range(120)]
    return rows + [(500, None), (501, ""), (502, " \t"), (503, "x " * 20_000), (504, "x " * 20_000), (505, "x " * 9)]


@pytest.mark.parametrize("options", [{}, {"small": 16, "block": 32, "depth": 2}])
def test_jaccard_join_finds_links_of_hot_groups(spark, options):
    rows = hot_rows()
    want = links_of(rows)
    degree = {i: sum(i in p for p in want) for i, _ in rows}
    found = {r.doc_id: r for r in jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), **options).collect()}
    assert sum(r.n_links for r in found.values()) >= 0.99 * sum(degree.values())
    assert all(found[i].n_links <= degree[i] for i in degree)
    assert all(found[a].class_id == found[b].class_id for a, b in want)


def test_filters_keep_columns_whose_names_clash(spark):
    texts = ["a b c d e f g", "a b c d e f g", "other words here", None, "", ""]
    df = frame(spark, texts)
    for made, n in ((exact_dedup.drop_duplicates(df), 3), (jaccard_join.keep_one(df), 5)):
        rows = made.collect()
        assert made.columns == df.columns and len(rows) == n
        assert all((r["__id"], r["__text"], r["__own_id"], r.root) == (-r.doc_id, "mine", "own", "r") for r in rows)
    twice = spark.createDataFrame([(None, ""), (None, ""), (1, "x y")], "doc_id long, text string")
    assert jaccard_join.keep_one(twice).count() == 3  # rows without shingles all stay


def test_empty_tables(spark):
    none = frame(spark, []).select("doc_id", "text")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    results = [
        piece_fst.encode_decode(none, public_tokenizers.path("piece_bpe_32k.model")), toxicity.score(none, toxicity.fit(none, labels)), token_counts.count_tokens(none, public_tokenizers.path("word_bpe_49k.json")),
        packing.pack(none, public_tokenizers.path("byte_bpe_50k.json")), secrets.scan(none), secrets.redact(none), substring_dedup.dedup_substrings(none), jaccard_join.jaccard_join(none), jaccard_join.keep_one(none),
        tiff.store_texts(none), exact_dedup.exact_dedup(none), exact_dedup.drop_duplicates(none), toxicity.drop_toxic(none, labels),
    ]
    assert [df.count() for df in results] == [0] * len(results)


def test_codecs_read_fixed_bytes():
    # nine codes of nine bits: clear, 7, 258, 8, 8, 258, 6, 6, end
    bits = "".join(f"{c:09b}" for c in (256, 7, 258, 8, 8, 258, 6, 6, 257))
    data = int(bits.ljust(88, "0"), 2).to_bytes(11, "big")
    assert tiff.lzw_decode(data, 9) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    packed = bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")
    assert tiff.packbits_decode(packed, 24) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22" + "AA" * 10)
    with pytest.raises(ValueError):
        tiff.lzw_decode(int(f"{256:09b}{7:09b}{300:09b}".ljust(32, "0"), 2).to_bytes(4, "big"), 9)


def _tiff(tags, body=b"", order="<"):
    """A file of one directory made by hand: (tag, kind, value) with one value each."""
    entries = b"".join(struct.pack(order + "HHI", t, k, 1) + struct.pack(order + ("I" if k == 4 else "HH"), *((v,) if k == 4 else (v, 0))) for t, k, v in sorted(tags))
    head = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8 + len(body))
    return head + body + struct.pack(order + "H", len(tags)) + entries + struct.pack(order + "I", 0)


@pytest.mark.parametrize("order", ["<", ">"])
def test_pages_by_hand_and_broken_files(spark, order):
    tags = lambda width, height, size, codec=1: [(256, 4, width), (257, 4, height), (258, 3, 8), (259, 3, codec), (273, 4, 8), (277, 3, 1), (278, 4, height), (279, 4, size), (317, 3, 2)]
    good = _tiff(tags(3, 2, 6), bytes([10, 1, 1, 250, 10, 0]), order)
    rows = [(1, good), (2, _tiff(tags(0, 2, 6), b"abcdef", order)), (3, _tiff(tags(10**6, 10**6, 6), b"abcdef", order)), (4, _tiff(tags(10**9, 10**9, 6, 8), zlib.compress(b"a"), order)), (5, _tiff(tags(3, 4, 6), b"abcdef", order)), (6, good[:20]), (7, b""), (8, None)]
    found = {}
    for r in tiff.decode_pages(spark.createDataFrame([(i, None if d is None else bytearray(d)) for i, d in rows], "doc_id long, data binary")).collect():
        found[r.doc_id] = (r.page, r.width, r.height, None if r.pixels is None else bytes(r.pixels), r.error is None)
    assert found[1] == (0, 3, 2, bytes([10, 11, 12, 250, 4, 4]), True)
    assert all(found[i][0] == -1 and not found[i][4] for i in range(2, 8)) and 8 not in found


def test_texts_stored_as_pages_equal_plain_bytes(spark):
    some = [None, "", "a", "a", "\u00e9" * 400, "x" * 200_000, *("t%d " % k * (k * 7) for k in range(40))]
    found = {r.doc_id: r for r in tiff.store_texts(frame(spark, some)).collect()}
    layouts = set()
    for i, t in enumerate(some):
        data = (t or "").encode()
        payload = data + b"\xff" * (-len(data) % 576 if data else 576)
        r = found[i]
        media = tiff.write_tiff(tiff.to_pages(payload), **tiff.layout_of(payload))
        layouts.add(tuple(tiff.layout_of(payload).items()))
        x = np.frombuffer(payload, np.uint8)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        assert r.feature.startswith(f"pages={-(-len(payload) // (576 * 256))};mean={x.mean():.3f};sd={x.std():.3f};")
    assert len(layouts) >= 4


def test_archives_with_repeated_pages_and_clashing_columns(spark):
    big = "<p>\u00e9</p>" * 400
    rows = [(1, "u", big, "x"), (1, "u", big, "x"), (3, "v", big, "x"), (None, None, big, "x"), (5, "w", None, "x"), (5, "w", "", "x"), (7, "a\r\nX: y", "<p>", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").withColumnsRenamed({"digest": "first"})
    found = warc.archive_pages(pages, segment_bytes=300).collect()
    assert sorted((r.page_id or 0, r.record_type, r.refers_to) for r in found) == [(0, "revisit", 1), (1, "response", None), (1, "response", None), (3, "revisit", 1), (5, "response", None), (5, "response", None), (7, "response", None)]
    assert all(r.error is None and r.digest_ok is not False for r in found)


def test_pipeline_equals_plain_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(1)
    folder = "/root/testdata/sf0.01"
    base = [[f"k{rng.randrange(500)}" for _ in range(60)] for _ in range(12)]
    toxic = [r.text for r in spark.read.parquet(f"{folder}/documents.parquet").join(spark.read.parquet(f"{folder}/labels.parquet").filter("toxic = 1").select("doc_id"), "doc_id").collect()]
    texts = [" ".join(b) for b in base for _ in range(2)] + [" ".join(b[:-1] + ["other"]) for b in base] + toxic + [None, "", "key AKIAQ7Q7Q7Q7Q7Q7Q7 here", 'password="hunter2hunter2" and more']
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    data = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    known = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("doc_id + 1000000 AS doc_id", "text")
    labels = spark.read.parquet(f"{folder}/labels.parquet").selectExpr("doc_id + 1000000 AS doc_id", "quality", "toxic")
    data = data.unionByName(known.selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "length(text) AS n_chars"))
    data.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    data, labels = spark.read.parquet(str(tmp_path / "documents.parquet")), spark.read.parquet(str(tmp_path / "labels.parquet"))
    left = {r.doc_id: r.text for r in data.collect()}

    lexicon = toxicity.fit(data, labels)
    bias, a, b = lexicon.curve

    def clean(text):
        total, n = plain_features(lexicon, text or "")
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, bias + a * total**0.5 + b * total / max(1, n))))) < 0.5

    left = {i: t for i, t in left.items() if clean(t)}
    best: dict = {}
    for i, t in left.items():
        best[t or ""] = max(best.get(t or "", i), i)
    left = {i: t for i, t in left.items() if best[t or ""] == i}
    least = {i: i for i in left}
    for x, y in links_of([(i, t) for i, t in left.items() if len((t or "").split()) < 2000]):
        rx, ry = least[x], least[y]
        for i in least:
            if least[i] in (rx, ry):
                least[i] = min(rx, ry)
    left = {i: t for i, t in left.items() if least[i] == i}

    def redacted(text):
        at, parts = 0, []
        for s, k, e in plain_spans(text or "")[1]:
            if s >= at:
                parts += [text[at:s], f"[{secrets.KINDS[k].upper()}]"]
            at = max(at, e)
        return "".join(parts) + (text or "")[at:]

    from tokenizers import Tokenizer

    rules = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for i, t in left.items():
        ids = [*rules.encode(redacted(t), add_special_tokens=False).ids, 2]
        want[i] = (len(ids), -(-len(ids) // 1024))
    found: dict = {}
    placed: dict = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        n, k = found.get(r.doc_id, (0, 0))
        found[r.doc_id] = (n + r.length, k + 1)
        placed.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert found == want
    assert all(sum(n for _, n in sorted(p)[:k]) == at and at + n <= 1024 for p in placed.values() for k, (at, n) in enumerate(sorted(p)))


def test_what_operators_store_can_be_swept(spark):
    import os

    from wavelattice.llm import shared

    rows = [(i, "a b c d e f g " * 9) for i in range(5)]
    before = set(os.listdir(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")))
    shared.sweep(spark)
    assert substring_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"), size=5, anchor=2).count() == 5
    assert shared.sweep(spark) > 3 and shared.sweep(spark) == 0
    left = set(os.listdir(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))) - before
    assert not [x for x in left if x.startswith("wl-")]
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("wl_")]
