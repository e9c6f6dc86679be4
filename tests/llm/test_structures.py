"""The conversation trie, the divergence of sources and maximal repeats against brute force, with nulls, ties, repeats and hot keys."""

import hashlib
import random
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from fixtures import documents, frame

from dovetail.llm import conversation_trie, source_divergence, suffix_repeats

# trie


def _nodes(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        built[c] = own.get(base, [])[:h] + turns[h:]
    members, kids, leaves, saved = defaultdict(list), Counter(), Counter(), Counter()
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    for n in members:
        if n:
            kids[n[:-1]] += 1
    for n, m in members.items():
        for d in range(len(n) + 1):
            saved[n[:d]] += (len(m) - 1) * len(n[-1][1].encode()) if n else 0
            leaves[n[:d]] += not kids[n]
    ends = lambda n: ",".join(str(c) for c in sorted(members[n]) if len(built[c]) == len(n))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return sorted((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), kids[n], leaves[n], saved[n], sha(ends(n))) for n, m in members.items())


def _conversations(seed):
    rng, rows = random.Random(seed), []
    for c in range(70):
        for t in range(rng.choice([0, 1, 2, 5, 9, 13])):
            rows.append((c if rng.random() < 0.97 else -c, rng.choice([None, t, t, t]), rng.choice([None, "user", "assistant"]) if t > 2 else "user", rng.choice([None, "", "a", "bé", "hello"]) if t > 2 else rng.choice("ab")))
    for c in (200, 205, 210, 333):  # long copies
        rows += [(c, t, "user", f"x{t % 7}") for t in range(25)]
    return [*rows, *[(405, t, "user", "a") for t in range(31)], *[(500, 1, "u", "same")] * 20, (None, 0, "user", "a")]


@pytest.mark.parametrize("local_ids,most_joined", [(200_000, 1_000), (9, 1)])
def test_trie_against_brute_force(spark, local_ids, most_joined):
    rows = _conversations(local_ids)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3).withColumns({"n": F.lit(1), "pos": F.lit("x"), "digest": F.lit(0)})
    got = conversation_trie.conversation_trie(df, local_ids, most_joined)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    key = lambda r: (r[0], r[1])
    assert sorted((tuple(r) for r in got.select(columns).collect()), key=key) == sorted(_nodes(rows), key=key)


def test_trie_of_nothing(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversation_trie.conversation_trie(empty).count() == 0


# sources


def _divergence(rows, least_docs, top):
    letters = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c if c.isalpha() and c.isascii() or ord(c) > 127 else " " for c in t or "").split(" ")
    docs, n, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, *_ in rows:
        words = [w for w in letters(text) if w]
        groups.add((lang or "", source or ""))
        n[lang or "", source or ""].update(words)
        docs[lang or ""].update(set(words))
    out = set()
    for lang, source in groups:
        kept = sorted(t for t, k in docs[lang].items() if k >= least_docs)
        p = {}
        for s in [None, *(s for la, s in groups if la == lang)]:
            count = Counter() if s is not None else sum((n[g] for g in groups if g[0] == lang), Counter())
            count = n[lang, s] if s is not None else count
            total = sum(count[t] for t in kept)
            p[s] = {t: 1 + 10**9 * (count[t] + 5) // (total + 5 * len(kept)) for t in kept}
        pairs = [(-sum(abs(p[source][t] - p[s][t]) for t in kept), s.encode(), s) for s in p if s is not None and s != source]
        terms = [(-(p[source][t] - p[None][t]), t.encode(), t) for t in kept if n[lang, source][t] > 0 and p[source][t] > p[None][t]]
        for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
            out |= {(lang, source, part, item, -value, k) for k, (value, _, item) in enumerate(found, 1)}
    return out


def test_divergence_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(source_divergence, "BLOCK_TERMS", 7)  # several blocks of terms and of sources
    monkeypatch.setattr(source_divergence, "BLOCK_GROUPS", 2)
    rows = documents(41) + [(900 + i, f"common words É{i % 3} of all", "en", f"src{i % 6}", 1) for i in range(40)] + [(990, "", "xx", "a", 0), (991, None, "xx", None, 0), (992, "!", None, "a", 0)]
    df = frame(spark, rows).withColumns({"term": F.lit("x"), "n": F.lit(2), "block": F.lit(1)}).repartition(3)
    for least, top in ((3, 4), (1000, 50)):
        got = {tuple(r) for r in source_divergence.divergence(df, least, top).select("lang", "source", "part", "item", "value", "rank").collect()}
        assert got == _divergence(rows, least, top)
    assert source_divergence.divergence(frame(spark, [])).count() == 0


def test_shares_are_exact_beyond_64_bits():
    import numpy as np

    for count, total, kept in ((9 * 10**14, 9 * 10**15 - 10**9, 10**6), (0, 0, 1), (7, 123, 9)):
        got = source_divergence.shares(np.array([[count]]), np.array([[total]]), kept)[0, 0]
        assert got == 1 + 10**9 * (count + 5) // (total + 5 * kept)


# repeats


def _removed(rows, least):
    rank = lambda d: -(1 << 63) if d is None else d
    raw, first = [(d, (t or "").encode()) for d, t in rows], {}
    for d, b in raw:
        for i in range(len(b) - least + 1):
            w = b[i : i + least]
            first[w] = min(first.get(w, rank(d)), rank(d))
    out = []
    for d, b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - least + 1):
            if first[b[i : i + least]] < rank(d):
                gone[i : i + least] = b"\1" * least
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def _texts():
    rng = random.Random(5)
    rows = [(r[0], r[1]) for r in documents()]
    rows += [(1000 + i, "a" * rng.randrange(40, 300) + rng.choice(["", "b" * 70, "\0" * 60])) for i in range(8)]
    rows += [(2000 + i, "".join(rng.choice("ab") for _ in range(rng.randrange(5))) + rows[3][1][20 : rng.randrange(60, 200)] + "é\0" * rng.randrange(40)) for i in range(20)]
    return rows


@pytest.mark.parametrize("least,hot", [(50, 20_000), (50, 3)])
def test_repeats_against_brute_force(spark, least, hot):
    rows = _texts()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"th": F.lit("x"), "start": F.lit(1), "owner": F.lit(2)}).repartition(3)
    found = suffix_repeats.remove_repeats(df, least, hot)
    assert sorted((tuple(r) for r in suffix_repeats.digest(found).collect()), key=str) == _removed(rows, least)


def test_maximal_repeats_have_all_their_occurrences(spark):
    rows = [(i, t) for i, t in enumerate(t for _, t in _texts() if t and "a" * 60 not in t and "\0" not in t and "same" not in t)]  # no periodic text
    raw = {d: t.encode() for d, t in rows}
    groups, length = defaultdict(set), {}
    for r in suffix_repeats.maximal_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        groups[r.repeat].add((r.doc_id, r.start))
        length[r.repeat] = r.length
    assert len(groups) > 20
    for k, found in groups.items():
        d, at = next(iter(found))
        text = raw[d][at : at + length[k]]
        every = {(d, i) for d, b in raw.items() for i in range(len(b)) if b.startswith(text, i)}
        assert found == every and len(found) > 1


def test_stack_scan():
    rng = random.Random(3)
    for _ in range(200):
        lcp = [0] + [rng.choice([0, 50, 51, 55, 60]) for _ in range(rng.randrange(12))]
        want = set()
        for a in range(len(lcp)):
            for b in range(a + 1, len(lcp)):
                least = min(lcp[a + 1 : b + 1])
                if least >= 50 and lcp[a] < least and (b + 1 == len(lcp) or lcp[b + 1] < least):
                    want.add((least, a, b))
        assert set(suffix_repeats.intervals(lcp, 50)) == want


def test_bytes_after_a_span_do_not_part_a_repeat():
    """A span that ends where two others go on, followed in memory by bytes that sort between theirs."""
    w = bytes(range(60, 110))
    spans = [w, b"m" * 60, w + b"ma", w + b"mz"]
    r = suffix_repeats.Repeats(np.frombuffer(b"".join(spans), np.uint8), np.array([len(s) for s in spans]), 50)
    found = {(n, tuple(sorted(zip(r.span[a:b].tolist(), r.offset[a:b].tolist())))) for n, a, b in zip(r.length.tolist(), r.low, r.high)}
    assert {(51, ((2, 0), (3, 0))), (50, ((0, 0), (2, 0), (3, 0)))} <= found


def test_repeats_of_nothing(spark):
    for rows in ([], [(None, None), (1, ""), (2, "short")]):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert all(r.removed == [] for r in suffix_repeats.remove_repeats(df).collect())
        assert suffix_repeats.maximal_repeats(df).count() == 0
