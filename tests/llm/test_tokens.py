import sys
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers import models as token_models

sys.path.insert(0, str(Path(__file__).parent))
from fixtures import documents, frame, prose

from dovetail.llm import common, packing, trie_counts, wavelet
from dovetail.llm.encoding import ChunkEncoder

BPE = public_tokenizers.path("word_bpe_49k.json")
whole = Tokenizer.from_file(BPE)
chunks = ChunkEncoder(BPE)


def ids(text):
    return np.array(whole.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(blacklist_categories=["Cs"]), st.sampled_from(list("abcXYZ .,'!<|>endoftext\n\tÉéßΣİ́ſ'sll0129"))), max_size=40))
def test_chunks_are_exact(text):
    assert chunks.encode(text) == ids(text)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=200))
def test_wavelet(tokens):
    a = np.array(tokens, np.uint32)
    shard = wavelet.WaveletShard(wavelet.build(a, np.array([7]), np.array([len(a)])))
    assert shard.decode().tolist() == tokens
    for i, t in enumerate(tokens[:20]):
        assert shard.access(i) == t
        assert shard.rank(t, i) == tokens[:i].count(t)
    for t in [*tokens[:5], 9999]:
        where = [i for i, x in enumerate(tokens) if x == t]
        assert shard.count(t) == len(where) and shard.occurrences(t) == where


def test_wavelet_over_blocks():
    a = np.random.default_rng(0).integers(0, 5, 200_000).astype(np.uint32)
    shard = wavelet.WaveletShard(wavelet.build(a, np.array([1]), np.array([len(a)])))
    where = np.flatnonzero(a == 3)
    assert shard.count(3) == len(where) and shard.select(3, 30_000) == where[30_000] and shard.access(150_001) == a[150_001]


def test_shards(spark):
    rows = documents()
    path = common.new_path(spark, "test")
    wavelet.write_shards(frame(spark, rows), path, BPE, shard_tokens=500)
    got = [tuple(r)[:4] for r in wavelet.read_documents(spark, path).collect()]
    want, at = [], 0
    hashed = {(r.doc_id, r.text): r.th for r in frame(spark, rows).select("doc_id", "text", F.xxhash64("text").alias("th")).collect()}
    for doc, text in sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, hashed[r])):
        raw = ids(text) + (2).to_bytes(4, "little")
        want.append((doc, at, len(raw) // 4, zlib.crc32(raw)))
        at += len(raw) // 4
    assert sorted(got, key=lambda r: r[1]) == want
    least = [(-(2**63), "a", "en", "s", 0), (None, "b", "en", "s", 0)]
    path = common.new_path(spark, "test")
    wavelet.write_shards(frame(spark, least), path, BPE)
    assert [r.doc_id for r in wavelet.read_documents(spark, path).orderBy("start").collect()] == [None, -(2**63)]
    empty = common.new_path(spark, "test")
    wavelet.write_shards(frame(spark, []), empty, BPE)
    assert wavelet.read_documents(spark, empty).count() == 0


@pytest.mark.parametrize("n", [0, 1, 40, 3000])
def test_plan_is_whole_and_gapless(n):
    lengths = np.minimum(64, np.random.default_rng(n).geometric(0.06, n))
    histogram = np.bincount(lengths, minlength=65)
    runs, sequences, _ = packing.plan(histogram, 64)
    places: dict[int, list] = {}
    placed = np.zeros(65, int)
    for length, first, count, sequence, offset in runs:
        assert first == placed[length]
        placed[length] += count
        for j in range(count):
            places.setdefault(sequence + j, []).append((offset, length))
    assert (placed == histogram).all() and len(places) == sequences
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 64
    assert sequences <= -(-lengths.sum() // 64) * 1.02 + 1


def test_fit_is_nonnegative_and_close():
    rows = packing.patterns(64)
    assert (rows.sum(1) == 64).all()
    target = np.zeros(65)
    np.add.at(target, rows[::7].ravel(), 5.0)
    target[0] = 0
    x = packing.nonnegative_fit(rows, target)
    used = np.bincount(rows.ravel(), np.repeat(x, 4), 65)
    assert (x >= 0).all() and np.linalg.norm((used - target)[1:]) < 0.05 * np.linalg.norm(target)


def test_packing(spark):
    rows = documents()
    pieces = common.stash(packing.cut_pieces(frame(spark, rows), BPE, 128), "test")
    got = [tuple(r) for r in packing.pack(pieces, 128).collect()]
    want = []
    for doc, text, *_ in rows:
        raw = ids(text) + bytes(4)
        want += [(doc, k, a // 4, len(p) // 4, zlib.crc32(p)) for k, a in enumerate(range(0, len(raw), 512)) for p in [raw[a : a + 512]]]
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted((r[:5] for r in got), key=key) == sorted(want, key=key)
    at: dict[int, int] = {}
    for *_, length, _, sequence, offset in sorted(got, key=lambda r: (r[5], r[6])):
        assert offset == at.get(sequence, 0)
        at[sequence] = offset + length
    assert max(at.values()) <= 128
    assert packing.pack(common.stash(packing.cut_pieces(frame(spark, []), BPE, 128), "test"), 128).count() == 0


def _fewest(word, scores, byte):
    text = trie_counts.MARK + word
    best = [(0.0, 0)]
    for end in range(1, len(text) + 1):
        width = len(text[end - 1].encode())
        options = [(best[end - 1][0] + byte * width, -(best[end - 1][1] + width))]
        options += [(best[a][0] + scores[text[a:end]], -(best[a][1] + 1)) for a in range(end) if text[a:end] in scores]
        s, n = max(options)
        best.append((s, -n))
    return best[-1][1]


def test_trie_counts(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    scores = trie_counts.vocabulary(path)
    byte = min(scores.values()) - 10
    rows = documents()
    got = sorted((tuple(r) for r in trie_counts.count_tokens(frame(spark, rows), path).collect()), key=str)
    want = sorted(((d, len((t or "").split()), sum(_fewest(w, scores, byte) for w in (t or "").split())) for d, t, *_ in rows), key=str)
    assert got == want
    assert trie_counts.count_tokens(frame(spark, []), path).count() == 0


def test_long_pretokens_are_counted_alike():
    counter = trie_counts.TrieCounter(trie_counts.vocabulary(public_tokenizers.path("piece_bpe_32k.model")))
    long = ["ab" * 200, "the" * 300 + "é☃" * 40, "x" * 5000]
    counter.insert(long)
    assert [counter.long_count(w) for w in long] == [counter.known[w] for w in long]
    known = dict(counter.known)
    counter.known.clear()
    assert counter.counts([" ".join(long)]) == [(3, sum(known.values()))] and not set(long) & set(counter.known)


def test_trie_counts_against_a_unigram_model():
    scores = trie_counts.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    vocabulary = list(scores.items())
    model = token_models.Unigram([*vocabulary, ("<unk>", -100.0)], len(vocabulary), False)
    import random

    counter = trie_counts.TrieCounter(scores)
    texts = prose(random.Random(3), 400).split()
    counter.insert(set(texts))
    assert all(counter.known[w] == len(model.tokenize(trie_counts.MARK + w)) for w in texts)
    assert counter.nodes < sum(len(w) + 1 for w in set(texts))
