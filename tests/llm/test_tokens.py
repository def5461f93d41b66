import hashlib
import random
import zlib

import numpy as np
import pytest
import sentencepiece
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quire.llm import flat_tokens, sentencepiece_np, separator_scan, word_tokens

from .common import PIECES, WORDS, frame, messy

LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PIECES)
MODEL = sentencepiece_np.PieceModel(PIECES)
TOKENIZER = Tokenizer.from_file(WORDS)
SLOW = sentencepiece_np.model


def ids_of(model, texts):
    flat, counts = model.encode(texts)
    ends = np.cumsum(counts)
    return [flat[e - c : e].tolist() for e, c in zip(ends, counts)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("abein rst\n.,0é▁▁  日😀\x00=<>s/"), max_size=60), max_size=8))
def test_pieces_equal_the_library(texts):
    got = ids_of(MODEL, texts)
    assert got == [LIBRARY.encode(t, add_eos=True) for t in texts]
    assert [MODEL.decode(x) for x in got] == [LIBRARY.decode(x) for x in got]


def test_unsafe_simultaneous_merges():
    rng = random.Random(5)
    parts = ["in", "er", "an", "the", "ing", "ation", "a", "b", "aba", "ss", "s", " "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(3000)] + ["a" * n for n in range(1, 80)] + ["ab" * 700]
    assert ids_of(MODEL, texts) == [LIBRARY.encode(t, add_eos=True) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 31999), max_size=12))
def test_any_ids_decode_as_the_library_does(ids):
    assert MODEL.decode(ids) == LIBRARY.decode(ids)


def test_cache_limit_changes_nothing():
    small = sentencepiece_np.PieceModel(PIECES)
    small.cache.limit = 3
    texts = [t or "" for _, t in messy(3, 10)]
    assert sum((ids_of(small, texts[i : i + 4]) for i in range(0, len(texts), 4)), []) == ids_of(MODEL, texts)


def test_round_trip_and_operators(spark):
    rows = messy(4, 10)
    docs = frame(spark, rows)
    want = sorted((str(i), len(x), hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(LIBRARY.decode(x).encode()).hexdigest()) for i, t in rows for x in [LIBRARY.encode(t or "", add_eos=True)])
    got = sentencepiece_np.round_trip(docs, PIECES, with_ids=True).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want and all(len(r.ids) == r.n_tokens for r in got)
    both = sentencepiece_np.decode(sentencepiece_np.encode(docs, PIECES), PIECES).collect()
    assert all(r.decoded == LIBRARY.decode(LIBRARY.encode(r.text or "")) and r.slot == 1 for r in both)
    assert sentencepiece_np.encode(docs.where("false"), PIECES).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("abcXYZ '’.,<|>éÉßİΣς̸́0²５ \n\t\v\x1c\x85   日ſK≠=😀dsten"), max_size=40), max_size=8))
def test_words_equal_the_library(texts):
    tok = word_tokens.tokenizer(WORDS)
    flat, counts = tok.encode(texts)
    ends = np.cumsum(counts)
    assert [flat[e - c : e].tolist() for e, c in zip(ends, counts)] == [e.ids for e in TOKENIZER.encode_batch(texts, add_special_tokens=False)]


def encoder(end, plain=False):
    def make():
        tok = word_tokens.tokenizer(WORDS, plain)
        return lambda texts: tok.encode(texts, end)

    return make


@pytest.mark.parametrize("buckets", [1, 5])
def test_files_read_back(spark, tmp_path, buckets):
    rows = [r for r in messy(5, 15)]
    folder = f"file://{tmp_path}/flat"
    manifest = flat_tokens.write(frame(spark, rows), encoder(1), "<u2", folder, buckets)
    got = flat_tokens.read_documents(spark, manifest, folder, "<u2").orderBy("start").collect()
    ids = {}
    for i, t in rows:
        x = TOKENIZER.encode(t or "", add_special_tokens=False).ids + [1]
        ids.setdefault(i, []).append((len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
    order = sorted((i is None, i or 0) for i, _ in rows)
    assert [(r.doc_id is None, r.doc_id or 0) for r in got] == order
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])[:-1]]).tolist()
    for r in got:
        assert (r.n_tokens, r.ids_crc32) in ids[r.doc_id]
    # the files alone: uint16 ids, uint64 offsets
    total = sum(np.fromfile(p, "<u2").size for p in (tmp_path / "flat").glob("*.bin"))
    assert total == sum(r.n_tokens for r in got) and not list((tmp_path / "flat").glob("*.bin.*"))
    empty = flat_tokens.write(frame(spark, rows).where("false"), encoder(1), "<u2", folder + "2", buckets)
    assert flat_tokens.read_documents(spark, empty, folder + "2", "<u2").count() == 0


def test_hot_ids_are_cut_by_their_texts(spark, tmp_path):
    rows = [(7, f"text {i}") for i in range(300)] + [(i, f"own {i}") for i in range(60)] + [(None, f"no id {i}") for i in range(300)] + [(2**63 - 1, "last"), (-(2**63), "first")]
    folder = f"file://{tmp_path}/hot"
    manifest = flat_tokens.write(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), encoder(1), "<u2", folder, 12)
    assert manifest.count() >= 8 and max(r.n_docs for r in manifest.collect()) < 200
    got = flat_tokens.read_documents(spark, manifest, folder, "<u2").orderBy("start").collect()
    at = lambda t: (xxhash.xxh64(t.encode(), seed=42).intdigest() + 2**63) % 2**64
    want = []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, at(r[1]))):
        x = TOKENIZER.encode(t, add_special_tokens=False).ids + [1]
        want.append((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
    assert [(r.doc_id, r.n_tokens, r.ids_crc32) for r in got] == want
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([n for _, n, _ in want])[:-1]]).tolist()


def test_ranges_of_files(tmp_path):
    from pyarrow import fs

    data = np.arange(1000, dtype="<u2")
    data.tofile(tmp_path / "x.bin")
    for store, path in ((fs.LocalFileSystem(), f"{tmp_path}/x.bin"), (fs.SubTreeFileSystem(str(tmp_path), fs.LocalFileSystem()), "x.bin")):
        flat = flat_tokens.Flat(store, path, "<u2")
        assert len(flat) == 1000 and flat.read(5, 9).tolist() == [5, 6, 7, 8] and flat.read(998, 2000).tolist() == [998, 999]
        assert [(at, len(x)) for at, x in flat.blocks(10, 30, 8)] == [(10, 8), (18, 8), (26, 4)]


def test_documents_that_cross_blocks(spark, tmp_path):
    rows = [(0, ""), (1, "word " * (flat_tokens.BATCH_IDS + 5000)), (2, None), (3, "x y z"), (None, "end")]
    folder = f"file://{tmp_path}/long"
    manifest = flat_tokens.write(spark.createDataFrame(rows, "doc_id long, text string"), encoder(1), "<u2", folder, 1)
    for r in flat_tokens.read_documents(spark, manifest, folder, "<u2").collect():
        x = TOKENIZER.encode(dict(rows)[r.doc_id] or "", add_special_tokens=False).ids + [1]
        assert (r.n_tokens, r.ids_crc32) == (len(x), zlib.crc32(np.array(x, "<u4").tobytes()))


@pytest.mark.parametrize("block", [1, 7, 64, 1 << 20])
def test_separator_scan(spark, tmp_path, block):
    rng = random.Random(block)
    files, want = [], {}
    for b in range(3):
        ids = [rng.choice([9, 9, 1, 2, 3]) if b else rng.choice([1, 2]) for _ in range(rng.randint(0, 40))]
        if b == 2:
            ids = [9] * 5
        np.array(ids, "<u2").tofile(tmp_path / f"{b}.bin")
        files.append({"bucket": b, "n_tokens": len(ids)})
        n = k = 0
        for x in ids:
            if x == 9:
                want[b, k] = (n, True)
                n, k = 0, k + 1
            else:
                n += 1
        if n:
            want[b, k] = (n, False)
    got = separator_scan.scan(spark, files, f"file://{tmp_path}", "<u2", 9, block).collect()
    assert {(r.bucket, r.doc_no): (r.n_tokens, r.complete) for r in got} == want and len(got) == len(want)


def test_token_counts(spark, tmp_path):
    rows = messy(6, 10)
    plain = Tokenizer.from_file(WORDS)
    plain.encode_special_tokens = True
    folder = f"file://{tmp_path}/scan"
    manifest = flat_tokens.write(frame(spark, rows), encoder(49407, True), "<u2", folder, ordered=False)
    got = separator_scan.token_counts(spark, manifest, folder, "<u2", 49407, 50).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == sorted((str(i), len(plain.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)


def test_runs_of_spaces_equal_the_library():
    texts = [before + " " * n + after for n in range(70) for before in ("", "a", "x\n") for after in ("", "b", "\n", ".")]
    flat, counts = MODEL.encode(texts)
    ends = np.cumsum(counts)
    assert [flat[e - c : e].tolist() for e, c in zip(ends, counts)] == [LIBRARY.encode(t, add_eos=True) for t in texts]
