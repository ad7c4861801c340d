"""Small fixtures against the libraries or brute force; nulls, empties, ties, repeats, long texts, clashing columns."""

import re
from itertools import combinations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as hs

from wavelattice.llm import exact_dedup, jaccard_join, packing, piece_fst, secrets, substring_dedup, tiff, token_counts, toxicity, warc

SCHEMA = "doc_id long, text string, bucket string, h long, node string, path long"
ODD = [None, "", " ", "a", "A a", "I'm 'LL don't 123 <|endoftext|>x", "naïve ﬁ é 　x\x85y", "🙂👍🏽 中文", "x" * 3000, "  two  blanks \n\t end ", "a▁b <s> <0x0A>"]
texts = hs.lists(hs.text(alphabet=hs.sampled_from("ab '.A1é▁\n\t🙂<|endoftext>"), max_size=60), min_size=1, max_size=8)


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y", 2) for i, t in rows], SCHEMA)


@settings(max_examples=60, deadline=None)
@given(texts)
def test_token_counts_equal_the_library(some):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    rules = Tokenizer.from_file(path)
    assert token_counts.count_texts(some, path, chunk_chars=5) == [len(rules.encode(t, add_special_tokens=False).ids) for t in some]


@settings(max_examples=60, deadline=None)
@given(texts)
def test_byte_ids_equal_the_library(some):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    rules = Tokenizer.from_file(path)
    assert [x.tolist() for x in packing.byte_tokenizer(path).encode(pa.array(some))] == [rules.encode(t, add_special_tokens=False).ids for t in some]


@settings(max_examples=60, deadline=None)
@given(texts)
def test_pieces_equal_the_library(some):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    machine = piece_fst.transducer(path)
    ids = machine.encode(some)
    assert [x.tolist() for x in ids] == [library.encode(t) for t in some]
    assert [machine.decode(x) for x in ids] == [library.decode(x.tolist()) for x in ids]


def test_packing_is_whole_and_gapless(spark):
    df = docs(spark, [(i, t) for i, t in enumerate(ODD)] + [(0, None), (None, "word " * 3000)])
    rows = packing.pack(df, public_tokenizers.path("byte_bpe_50k.json"), capacity=64).collect()
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    n = sum(r.length for r in rows)
    assert len(by_sequence) <= 1.2 * -(-n // 64) + 2
    assert packing.pack(docs(spark, []), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_plan_uses_up_any_histogram():
    counts = np.random.default_rng(3).integers(0, 50, 129)
    counts[0] = 0
    used = np.zeros(129, int)
    for lengths, n in packing.plan(counts, 128):
        assert sum(lengths) <= 128
        for v in lengths:
            used[v] += n
    assert (used == counts).all()


@settings(max_examples=40, deadline=None)
@given(hs.binary(max_size=5000))
def test_codecs_round_trip(data):
    assert tiff.lzw_decode(tiff.lzw_encode(data), len(data)) == data
    assert tiff.packbits_decode(tiff.packbits_encode(data), len(data)) == data
    assert warc.decode_chunked(warc.encode_chunked(data, 7)) == data


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
def test_tiff_pages(spark, compression):
    rng = np.random.default_rng(2)
    pages = [rng.integers(0, 9, (70, 100, 3), np.uint8), rng.integers(0, 255, (3, 17, 1), np.uint8)]
    for predictor in (1, 2):
        for tile in (0, 32):
            back = list(tiff.read_pages(tiff.write_tiff(pages, compression, predictor, 16, tile)))
            assert len(back) == 2 and all((a == b).all() for a, b in zip(pages, back))
    files = spark.createDataFrame([(1, bytearray(tiff.write_tiff(pages, compression))), (2, bytearray(b"II*")), (3, None)], "doc_id long, data binary")
    assert sorted((r.doc_id, r.page) for r in tiff.decode_pages(files).collect()) == [(1, 0), (1, 1), (2, -1)]
    assert tiff.store_texts(docs(spark, list(enumerate(ODD)))).filter("payload_bytes % 576 = 0 and payload_bytes >= n_bytes").count() == len(ODD)


def test_warc_segments_and_revisits(spark):
    big = "<p>é</p>" * 500
    rows = [(1, "u", big), (2, "u", big), (3, None, None), (4, "u", "small"), (5, "u", "small"), (None, "u", "x" * 300), (7, "u", big + "!")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r.page_id: r for r in warc.archive_pages(pages, segment_bytes=512).collect()}
    assert len(found) == 7 and all(r.error is None and r.digest_ok is not False for r in found.values())
    assert (found[2].record_type, found[2].refers_to, found[2].payload_bytes) == ("revisit", 1, len(big.encode()))
    assert found[5].record_type == "response" and found[3].payload_bytes == 0
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_broken_segments_are_reported(spark):
    def record(i, segment, origin=None, total=None, block=b"ab"):
        return (i, "continuation" if origin else "response", 1, None, None, origin, segment, total, bytearray(block))

    records = spark.createDataFrame([record("a", 1), record("a2", 3, "a", 6), record("b", 1), record("b2", 2, "b"), record("c", 1), record("c2", 2, "c", 5), record("d2", 2, "d", 4), record("d", 1)], warc.RECORDS)
    found = {r.record_id: (r.error, r.block) for r in warc.reassemble(records).collect()}
    assert found["d"] == (None, bytearray(b"abab"))
    assert [found[k][0] for k in "abc"] == ["segments are missing or repeated", "the last segment is missing", "total length differs"]


def test_exact_dedup(spark):
    rows = [(1, "a"), (2, "a"), (2, "a"), (3, None), (4, ""), (None, "b"), (6, "B"), (7, "z" * 100_000)]
    found = exact_dedup.exact_dedup(docs(spark, rows), capacity_rows=1).collect()
    assert len(found) == 8 and sum(r.kept for r in found) == 5
    assert {r.keep_id for r in found if r.doc_id in (1, 2)} == {2} and {r.group_size for r in found if r.doc_id == 3} == {2}
    kept = exact_dedup.drop_duplicates(docs(spark, rows))
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 2, 4, 6, 7] and kept.columns[2] == "bucket"
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0


def test_directory_splits_until_buckets_fit():
    rows = np.array([5, 1, 1, 1, 0, 0, 9, 1])
    depth, slots, local = exact_dedup.build_directory(rows, rows, 4, 10**9)
    width = len(rows) >> depth
    for b in set(slots.tolist()):
        mine = np.nonzero(slots == b)[0]
        total = sum(rows[s * width : (s + 1) * width].sum() for s in mine)
        assert len(mine) == 1 << (depth - local[b]) and (total <= 4 or local[b] == 3)


def test_substring_dedup_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(400)]
    passage = [words[k] for k in rng.integers(0, 400, 70)]
    rows = []
    for i in range(14):
        body = [words[k] for k in rng.integers(0, 400, 80)]
        rows.append((i, " ".join(body[:20] + (passage[: 55 + i] if i % 3 else []) + body[20:])))
    rows += [(20, rows[4][1]), (21, rows[4][1]), (22, None), (23, "short text"), (None, rows[1][1]), (25, " ".join(["same"] * 120)), (26, " ".join(["same"] * 60))]
    found = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.dedup_substrings(docs(spark, rows)).collect()}
    first = {}
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    split = {i: substring_dedup.words_of(t or "") for i, t in rows}
    for i, _ in order:
        w = split[i]
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    for i, _ in rows:
        w, gone = split[i], set()
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] != i:
                gone |= set(range(k, k + 50))
        assert found[i] == (len(w), len(gone)), i


def brute_links(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        k = min(5, len(w))
        sets[i] = {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if w else set()
    return {(a, b) for a, b in combinations(sorted(sets), 2) if sets[a] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])}


def test_jaccard_join_equals_brute_force(spark):
    rng = np.random.default_rng(6)
    base = [[f"v{k}" for k in rng.integers(0, 900, 90)] for _ in range(12)]
    rows, n = [], 0
    for body in base:
        for _ in range(6):
            copy = list(body)
            for at in rng.integers(0, 90, rng.integers(0, 4)):
                copy[at] = f"edit{n}"
            rows.append((n, " ".join(copy)))
            n += 1
    hot = " ".join(base[0][:60])
    rows += [(n + k, f"{hot} tail{k} of{k} it{k}") for k in range(30)] + [(200, "a b"), (201, "a b"), (202, None), (203, ""), (204, "a b c")]
    want = brute_links(rows)
    degree = {i: sum(i in p for p in want) for i, _ in rows}
    for options in ({}, {"small": 4, "block": 8}, {"small": 4, "block": 8, "depth": 0}, {"small": 4, "depth": 1}):
        found = {r.doc_id: r for r in jaccard_join.jaccard_join(docs(spark, rows), **options).collect()}
        assert {i: found[i].n_links for i in degree} == degree
        assert all(found[a].class_id == found[b].class_id for a, b in want)
    assert jaccard_join.keep_one(docs(spark, rows)).count() == len({r.class_id for r in found.values()})


def test_toxicity_finds_disguised_words(spark):
    assert toxicity.fold("You 1D10T! іdіоt café 2024") == " you idiot idiot cafe 2024 "
    lexicon = toxicity.Lexicon({" trash ": 4.0, " idio": 5.0}, list(toxicity.EXCEPTIONS), (-3.0, 2.0, 1.0))
    assert lexicon.score("put it in the trash can") < 0.5 < lexicon.score("what tr4sh")
    rows = [(i, f"plain words number{i % 7} here" + (" awful1" * (i % 4 == 0))) for i in range(200)] + [(None, None), (300, "")]
    labels = spark.createDataFrame([(i, 0, int(i % 4 == 0)) for i in range(200)], "doc_id long, quality int, toxic int")
    df = docs(spark, rows)
    scored = toxicity.score(df, toxicity.fit(df, labels)).collect()
    assert len(scored) == 202 and all(r.predicted == (r.doc_id is not None and r.doc_id < 200 and r.doc_id % 4 == 0) for r in scored)
    assert {r.score for r in toxicity.score(df, toxicity.fit(df, labels.limit(0))).collect()} == {0.0}


def test_secrets(spark):
    token = "q9Zr7Lk2Vx8Tb4Nw6Yc1Pd3Hs5"
    rows = [(1, f'API_KEY = "abcd1234" and AKIA{"A1" * 8} 🙂 {"0f" * 20}'), (2, "token=secret: abcdefgh"), (3, f"see {token} now"), (4, "sample-" + token), (5, None), (6, "x" * 500)]
    found = {r.doc_id: r for r in secrets.scan(docs(spark, rows)).collect()}
    assert (found[1].n_assign, found[1].n_access, found[1].n_hex) == (1, 1, 1)
    assert found[2].n_assign == 0 and found[3].spans == f"entropy:4:{4 + len(token)}" and found[4].spans == found[5].spans == found[6].spans == ""
    clean = {r.doc_id: r.text for r in secrets.redact(docs(spark, rows)).collect()}
    assert clean[1] == '[ASSIGN]" and [ACCESS] 🙂 [HEX]' and clean[3] == "see [ENTROPY] now" and clean[5] is None


def test_pipeline_keeps_columns(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    data = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:4]:
        after = stage(spark, data, folder)
        assert after.columns == data.columns and 0 < after.count() <= data.count(), name
        data = after
