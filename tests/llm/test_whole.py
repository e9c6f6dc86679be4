"""Posteriors, verdicts and the whole pipeline against plain versions of the formulas; the trained tables and trees are the operators' own."""

import math
import random
import re
import sys
import zlib
from pathlib import Path

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))
from fixtures import frame, link_classes
from test_text import _brute_lines, _contaminated

from dovetail.llm import language_id, url_filter

BAGS = {"en": ["the", "and", "thing", "wither", "other"], "de": ["der", "und", "nicht", "schein", "über"], "fr": ["les", "est", "leur", "père", "eau"]}


def _trigrams(text):
    """Hashes of three bytes in a row with a letter in the middle or at both ends."""
    letters = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in f" {text or ''} ".encode())
    for a, b, c in zip(letters, letters[1:], letters[2:]):
        if b != 32 or (a != 32 and c != 32):
            yield (((a * 0x9E3779B1) & 0xFFFFFFFF) ^ ((b * 0x85EBCA6B) & 0xFFFFFFFF) ^ ((c * 0xC2B2AE35) & 0xFFFFFFFF)) >> 19


def _softmax(logs):
    parts = [math.exp(x - max(logs)) for x in logs]
    return [x / sum(parts) for x in parts]


def _posteriors(rows, langs, table):
    """(lang, confidence) of rows of th, text, declared, suffix, domain, host, by the formulas of the module's text."""
    n, known = len(langs), langs[:-1]
    scored = []
    for th, text, *_ in rows:
        found = list(_trigrams(text))
        tempered = min(len(found), 200) / len(found) if found else 0.0
        scored.append((len(found), [tempered * sum(table[th % 2][i][b] for b in found) for i in range(n)]))
    start = [math.log((1 - 1e-4) / (n - 1))] * (n - 1) + [math.log(1e-4)]
    by_text = [_softmax([a + b for a, b in zip(x, start)]) for _, x in scored]
    counted = [t if size else [0.0] * n for (size, _), t in zip(scored, by_text)]
    total = lambda at, value: [sum(c[i] for r, c in zip(rows, counted) if value is None or r[at] == value) for i in range(n)]
    whole = [x + 1 for x in total(0, None)]
    whole = [x / sum(whole) for x in whole]
    said = [(r[2], t) for r, t, (size, _) in zip(rows, by_text, scored) if r[2] in known and size]
    share = (sum(t[known.index(lang)] for lang, t in said) + 9 * 0.9) / (len(said) + 9)

    def level(at, value, above, weight):
        counts = total(at, value) if value is not None else [0.0] * n
        return [(c + weight * p) / (sum(counts) + weight) for c, p in zip(counts, above)]

    out = []
    for (_, _, declared, suffix, domain, host), (size, loglik) in zip(rows, scored):
        prior = level(5, host, level(4, domain, whole, 50.0), 20.0)
        address = level(3, suffix, whole, 50.0)
        logs = []
        for i, lang in enumerate(langs):
            mark = 0.0 if declared not in known else math.log(share) if declared == lang else math.log(max(1e-6, 1 - share) / max(1, n - 2))
            logs.append(loglik[i] + math.log(prior[i]) + mark + (math.log(address[i] / whole[i]) if suffix is not None else 0.0))
        p = _softmax(logs)
        out.append((langs[p.index(max(p))], max(p)) if size else ("und", 0.0))
    return out


def _bag(rng, lang, k):
    return " ".join(rng.choice(BAGS[lang]) for _ in range(k))


def test_posteriors_against_brute_force(spark):
    rng = random.Random(21)
    langs, table = language_id.train(frame(spark, [(i, _bag(rng, k, 20), k, "h", 0) for i in range(40) for k in BAGS]))
    rows = []
    for i in range(150):
        lang = rng.choice(list(BAGS))
        text = rng.choice([_bag(rng, lang, rng.choice([1, 3, 40, 300])), "ok", "a 1", "", None, "12 !"])
        host = rng.choice([None, "a.x.de", "b.x.de", "c.y.fr", "d.org"])
        rows.append((i, text, rng.choice([lang, lang, None, "en", "xx"]), host and host.split(".")[-1], host and ".".join(host.split(".")[-2:]), host))
    df = spark.createDataFrame(rows, "page_id long, text string, declared string, suffix string, domain string, host string").withColumn("t0", F.lit("x"))
    got = {r.page_id: r for r in language_id.identify(df, langs, table).collect()}
    want = _posteriors([(got[r[0]].th, *r[1:]) for r in rows], langs, table)
    assert len(got) == len(rows)
    for (i, *_), (lang, p) in zip(rows, want):
        assert got[i].lang == lang and abs(got[i].confidence - p) < 1e-4, (i, lang, p, got[i])
        assert got[i].keep == (lang != "und" and p >= 0.5)


def _features(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].lower(), m[2]) if m else ("", "")
    asked = re.search(r"\?([^#]*)", url or "")
    size, url = len(host), url or ""
    used = [host.count(c) / size for c in "abcdefghijklmnopqrstuvwxyz0123456789-." if c in host]
    digits = lambda s: sum(c in "0123456789" for c in s)
    values = [len(url), size, len(path), path.count("/"), host.count("."), digits(url) / max(len(url), 1), digits(host), host.count("-")]
    return [*values, -sum(p * math.log2(p) for p in used), asked[1].count("&") + 1 if asked and asked[1] else 0, max(map(len, host.split(".")))]


def test_verdicts_against_brute_force(spark):
    rng = random.Random(22)
    urls = [None, "", "none", "http:///x?", "http://a.b/?q"]
    for _ in range(500):
        host = rng.choice(["spam-farm", "free-bets", "casino1"]) + str(rng.randrange(50)) if rng.random() < 0.4 else "".join(rng.choice("aeionrst") for _ in range(7))
        urls.append(f"http{rng.choice(['', 's'])}://{rng.choice(['', 'www.', 'a.b.'])}{host}.{rng.choice(['com', 'net', 'org', 'example.com'])}/{rng.choice(['en/', 'de/8', 'es/', 'fr'])}{rng.randrange(99)}{rng.choice(['', '?a=1', '?a=1&b=2#c', '#?x'])}")
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    host, path = url_filter.host_and_path(F.col("url"))
    features = url_filter.with_features(df.withColumns({"host": host, "path": path}))
    model, rates, rate, total = url_filter.fit(features, url_filter.SEED_WORDS)
    seen = {r.page_id: r for r in url_filter.with_rates(features, rates, rate, total).collect()}
    got = {r.page_id: r for r in url_filter.judge(df).collect()}
    assert model[1] and len(got) == len(urls)

    def leaf(tree, x):
        while not isinstance(tree, float):
            tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
        return tree

    for i, url in enumerate(urls):
        x = [seen[i][f] for f in url_filter.FEATURES]
        assert all(abs(a - b) < 1e-9 for a, b in zip(x, _features(url))), (url, x, _features(url))
        score = model[0] + sum(leaf(tree, x) for tree in model[1])
        fits = [r for r in url_filter.RULES if (got[i].host == r[0] or got[i].host.endswith("." + r[0])) and got[i].path.startswith(r[1])]
        best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
        assert abs(got[i].block_score - score) < 1e-9
        assert got[i].rule == (best and best[0] + best[1]) and got[i].verdict == (best[2] if best else "block" if score > 0 else "allow")


def _short_lines(rng, n, bag):
    return "\n".join(" ".join(rng.choice(bag) for _ in range(rng.randrange(4, 8))) for _ in range(n))


def test_run_against_brute_force(spark, tmp_path):
    import corpus_pipeline as p

    rng = random.Random(23)
    many = {k: [f"{w}{v}" for w in bag for v in ("", *bag)] for k, bag in BAGS.items()}
    shared = [_short_lines(rng, 6, many[k]) for k in BAGS]
    items = [(i, " ".join(rng.choice(many["en"]) for _ in range(k))) for i, k in enumerate([30, 13, 6])]
    texts = []
    for i in range(60):
        k = list(BAGS)[i % 3]
        parts = [_short_lines(rng, rng.randrange(3, 12), many[k])]
        if i % 5 == 0:
            parts.insert(rng.randrange(2), shared[i % 3])
        if i % 13 == 0:
            parts.append("\n".join(items[i % 2][1].split(" ", 6)))
        texts.append("\n".join(parts))
    near = texts[9].split(" ")
    texts += [texts[3], texts[3].upper(), " ".join([*near, "end"]), None, "", "12 34\n5", _short_lines(rng, 700, many["de"])]
    rows = [(7 * i + 1, t, list(BAGS)[i % 3] if i < 60 else "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = p.run(spark, str(tmp_path)).collect()

    docs = frame(spark, rows)
    hashes = {r.doc_id: r.th for r in docs.select("doc_id", F.xxhash64("text").alias("th")).collect()}
    judged = _posteriors([(hashes[d], t, lang, None, None, host) for d, t, lang, host, _ in rows], *language_id.train(docs))
    kept = [r for r, (lang, c) in zip(rows, judged) if lang != "und" and c >= 0.5]
    assert len(kept) == len(rows) - 3
    label = link_classes([r[1] for r in kept])
    kept = [r for i, (r, c) in enumerate(zip(kept, label)) if i == c]
    assert len(kept) == len(rows) - 6
    kept = _brute_lines(spark, kept)
    assert sum(len(t) for _, t in kept) < sum(len(r[1]) for r in rows if r[0] in {d for d, _ in kept})
    bad = {d for d, *_, hit in _contaminated(kept, items) if hit}
    assert bad
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for d, t in kept:
        if str(d) not in bad:
            ids = [*whole.encode(t, add_special_tokens=False).ids, 0]
            for k, a in enumerate(range(0, len(ids), 2048)):
                raw = b"".join(x.to_bytes(4, "little") for x in ids[a : a + 2048])
                want.append((d, k, a, len(raw) // 4, zlib.crc32(raw)))
    assert max(k for _, k, *_ in want) > 0
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    at = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert max(at.values()) <= 2048
