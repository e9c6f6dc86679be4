import hashlib
import random
import re
import sys
from pathlib import Path

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from fixtures import documents, frame, link_classes, lower_ascii, prose, shingle_set

from dovetail.llm import chat, components, decontamination, language_id, line_dedup, ngram_join, url_filter

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_similarity_classes(spark, monkeypatch):
    rng = random.Random(4)
    rows = documents()
    for g in range(3):  # groups of near copies, some of which only meet through others
        text = prose(rng, 80).split(" ")
        for i in range(40):
            copy = list(text)
            for _ in range(rng.randrange(0, 5)):
                copy[rng.randrange(len(copy))] = f"w{rng.randrange(10**6)}"
            rows.append((1000 + g * 100 + i, " ".join(copy), "en", "s", 0))
    monkeypatch.setattr(ngram_join, "BLOCK_CLASSES", 8)
    monkeypatch.setattr(ngram_join, "SLICE_BYTES", 20_000)
    got = ngram_join.similarity_classes(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    label = link_classes([r[1] for r in rows])
    least: dict[int, int] = {}
    for r, k in zip(rows, label):
        if r[0] is not None:
            least[k] = min(least.get(k, r[0]), r[0])
    want = sorted((str(r[0]), len(shingle_set(r[1])), str(least.get(k) if shingle_set(r[1]) else r[0])) for r, k in zip(rows, label))
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == want
    assert ngram_join.similarity_classes(frame(spark, [])).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 40)), st.sets(st.integers(0, 40)))
def test_suffix_bound_is_a_bound(a, b):
    import numpy as np

    assert ngram_join.suffix_bound(np.array(sorted(a)), np.array(sorted(b))) <= len(a ^ b)


def test_component_of_a_path(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(40)], "u long, v long")
    assert {r.root for r in components.components(edges).collect()} == {0}


def _brute_lines(spark, rows):
    """What stays by plain line hashing: of equal lines, that of the first row by (doc_id, hash of the text) stays, the first in it."""
    key = lambda line: " ".join(line.lower().split())
    texts = [(t,) for t in {t for _, t, *_ in rows}]
    hashes = {r.text: r.th for r in spark.createDataFrame(texts, "text string").select("text", F.xxhash64("text").alias("th")).collect()}
    rank = lambda d, t: (-(1 << 63) if d is None else d, hashes[t])
    first: dict[str, tuple] = {}
    for d, t, *_ in sorted(rows, key=lambda r: rank(r[0], r[1])):
        for line in (t or "").split("\n"):
            first.setdefault(key(line), rank(d, t))
    out = []
    for d, t, *_ in rows:
        lines = re.findall(r"[^\n]*\n|[^\n]+", t or "")
        seen, gone = set(), []
        for line in lines:
            k = key(line)
            gone.append(bool(k) and (first[k] < rank(d, t) or k in seen))
            seen.add(k)
        worded = [i for i, line in enumerate(lines) if line.split()]
        kept, run = list(lines), []
        for i in [*worded, None]:
            if i is not None and gone[i]:
                run.append(i)
                continue
            if run:  # blank lines inside a run go with it
                for j in range(run[0], i if i is not None else len(lines)):
                    kept[j] = ""
                if run[0] == worded[0]:
                    kept[: run[0]] = [""] * run[0]
            run = []
        out.append((d, None if t is None else "".join(kept)))
    return out


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(7)
    pool = [" ".join(rng.choice(["One", "two", "TWO", "three", "four."]) for _ in range(rng.randrange(1, 7))) for _ in range(40)] + ["", " \t"]
    rows = [(i // 2 if i % 9 == 0 else i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(9))), "en", "s", 1) for i in range(120)]
    rows += [(None, pool[0], "en", "s", 1), (None, f"{pool[0]}\n{pool[1]}", "en", "s", 1), (500, None, "en", "s", 1), (501, "", "en", "s", 1), rows[3]]
    # ids that two rows share, one long and one short, with a line that is nowhere else
    rows += [(7, "only here and\nnowhere else\n" * 3 + pool[5], "en", "s", 1), (7, "short", "en", "s", 1)]
    df = frame(spark, rows).withColumn("kept", F.lit(1)).withColumn("own", F.lit("mine"))
    for least in (6, 20):
        got = line_dedup.remove_repeats(df, min_words=least).collect()
        assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(_brute_lines(spark, rows), key=str)
        texts = {}
        for d, t, *_ in rows:
            texts.setdefault(d, []).append(t)
        for r in got:
            assert any((r.text or "") == "".join((t or "")[k.start : k.end] for k in r.kept) and r.n_removed == len(t or "") - len(r.text or "") for t in texts[r.doc_id])
            assert r.own == "mine"
    assert line_dedup.remove_repeats(frame(spark, [])).count() == 0


def test_passages_inside_lines(spark):
    rng = random.Random(12)
    bags = [["zu"], ["mo", "ka."], [f"v{i}" for i in range(9)], [f"w{i}" for i in range(5000)], [f"W{i}{'.' * (i % 3 == 0)}" for i in range(5000)]]
    rows, passages = [], {}
    for n in range(80):
        own = lambda k: " ".join(f"{rng.choice('abc')}{rng.randrange(10**9)}" for _ in range(k))
        passage = " ".join(rng.choice(bags[n % 5]) for _ in range(51))
        passages[n] = passage
        for half in (0, 1000):
            rows.append((n + half, f"{own(9)}\n{own(rng.randrange(1, 30))} {passage.upper() if half else passage} {own(rng.randrange(1, 30))}\n{own(4)}", "en", "s", 1))
    got = {r.doc_id: r for r in line_dedup.remove_repeats(frame(spark, rows)).collect()}
    for d, text, *_ in rows:
        gone = len(text.split()) - len(got[d].text.split())
        if d < 1000 and d % 5 > 2:
            assert got[d].n_removed == 0
        if d >= 1000:
            assert gone >= 20, (d, gone)
        own = [w for w in text.split() if re.fullmatch(r"[abc]\d+", w)]
        assert [w for w in got[d].text.split() if re.fullmatch(r"[abc]\d+", w)] == own  # what is only here stays
        assert got[d].text.count("\n") == 2


def test_short_lines_and_whole_copies_go(spark):
    rows = [(1, "All rights reserved here.\nA tale of the sea.", "en", "s", 1), (2, "Something else.\nAll rights reserved here.", "en", "s", 1), (3, "Two words", "en", "s", 1), (4, "two  WORDS", "en", "s", 1), (5, "文字列の長い行。次の行。", "en", "s", 1), (6, "文字列の長い行。次の行。", "en", "s", 1)]
    got = {r.doc_id: r.text for r in line_dedup.remove_repeats(frame(spark, rows)).collect()}
    assert got == {1: rows[0][1], 2: "Something else.\n", 3: "Two words", 4: "", 5: rows[4][1], 6: ""}
    phrase = "quite a few words that many use"
    rows = [(i, f"own{i} start {phrase} and end{i} here", "en", "s", 1) for i in range(5)]
    got = {r.doc_id: r.text for r in line_dedup.remove_repeats(frame(spark, rows)).collect()}
    assert got == {i: t for i, t, *_ in rows}  # a short phrase inside lines stays


def test_a_footer_goes_from_all_but_the_first(spark):
    footer = "ten words that stand at the foot of every page"
    rows = [(i if i % 3 else None, f"text {i} alone\n{footer}", "en", "s", 1) for i in range(60)]
    got = line_dedup.remove_repeats(frame(spark, rows)).collect()
    assert sum(footer in r.text for r in got) == 1 and sum(r.n_removed > 0 for r in got) == 59


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abÉİς. \n\t。", max_size=40), min_size=1, max_size=4))
def test_tiles_lie_in_their_text(texts):
    u = line_dedup.Units(texts)
    for k, t in enumerate(texts):
        mine = u.tile_text == k
        parts = [t[a:b] for a, b in zip(u.start[mine], u.end[mine])]
        assert u.size[k] == len(t)
        whole = re.sub(r"[ \n\t]+", "", t)
        assert "".join(re.sub(r"[ \n\t]+", "", p) for p in parts) == whole


def _contaminated(docs, items, width=13):
    windows: dict[tuple, set] = {}
    for i, t in items:
        w = _WORD.findall(lower_ascii(t))
        for a in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[a : a + width]), set()).add(i)
    out = []
    for d, t in docs:
        w = _WORD.findall(lower_ascii(t))
        hit, found = set(), set()
        for n in {len(k) for k in windows}:
            for a in range(len(w) - n + 1):
                if (k := tuple(w[a : a + n])) in windows:
                    found |= windows[k]
                    hit |= set(range(a, a + n))
        listed = ",".join(sorted(str(i) for i in found if i is not None))
        out.append((str(d), len(w), len(hit), len(found - {None}), hashlib.sha256(listed.encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out)


def test_decontamination(spark, monkeypatch):
    rng = random.Random(8)
    items = [(i, prose(rng, n)) for i, n in enumerate([40, 20, 13, 5, 1])] + [(10, None), (11, ""), (12, prose(rng, 30)), (None, prose(rng, 15))]
    items.append((13, items[0][1]))
    rows = documents()
    texts = [f"{prose(rng, 20)} {items[0][1].upper()} {prose(rng, 300)}", items[1][1] + " " + items[1][1], items[3][1], f"É{items[2][1]}", items[8][1]]
    rows += [(5000 + i, t, "en", "s", 0) for i, t in enumerate(texts)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = _contaminated([(r[0], r[1]) for r in rows], items)
    for most in (decontamination.MOST_WINDOWS, 0):  # broadcast, and by shuffle
        for name in ("MOST_WINDOWS", "MOST_KEYS", "MOST_TERMS"):
            monkeypatch.setattr(decontamination, name, most)
        got = decontamination.contamination(frame(spark, rows), bench).collect()
        assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == want
    assert decontamination.contamination(frame(spark, []), bench).count() == 0
    assert decontamination.contamination(frame(spark, rows), bench.limit(0)).where("contaminated or n_near > 0").count() == 0


def test_index_holds_positions_and_proximity(spark):
    texts = {1: "x alpha Beta y gamma z", 2: "gamma q q q q q q q q q q q q alpha beta", 3: "alpha", 4: "gamma alpha alpha beta"}
    bench = spark.createDataFrame([(1, "alpha beta gamma"), (2, "unseen alpha"), (3, "z")], "item_id long, text string")
    index = decontamination.Index(frame(spark, [(d, t, "", "", 0) for d, t in texts.items()]), bench)
    for r in index.postings.collect():
        assert r.positions == [i for i, w in enumerate(texts[r.doc_id].lower().split()) if w == r.term]
    found = {(r.doc_id, r.item_id): r["at"] for r in index.proximity(span=5).collect()}
    assert found == {(1, 1): [2], (4, 1): [3], (1, 3): [5]}  # beta is the rarest of item 1; item 2 has a term that is nowhere


def test_chat_round_trip(spark):
    rng = random.Random(2)
    letters = [*chat.CONTROL, "\\", "[", "<", "/", "INST]", " ", "\n", "é", "ok"]
    say = lambda: "".join(rng.choice(letters) for _ in range(rng.randrange(9)))
    for _ in range(3000):
        turns = [(rng.choice(["user", "assistant", "system", "tool", "", "[ROLE]"]), say()) for _ in range(rng.randrange(5))]
        text, spans = chat.render(turns)
        assert chat.parse(text) == turns
        assert [chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, None, None, None), (None, 0, "user", "x")]
    got = {r.conv_id: r for r in chat.read_back(chat.format_records(chat.records_of_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("m", F.lit(1))))).collect()}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got[1].turns_sha256 == digest("user\na\nassistant\nb\nassistant\nb\n") and got[1].loss_chars == 2 and got[1].loss_sha256 == digest("bb")
    assert got[2].turns_sha256 == digest("\n\n") and got[None].n_turns == 1


def test_layouts():
    layouts = chat.Layouts()
    assert layouts.turns({"instruction": "a", "input": "b", "output": "c"})[1:] == ("instruction input", [("user", "a\n\nb"), ("assistant", "c")])
    assert layouts.turns({"conversations": [{"from": "human", "value": "x"}, {"from": "gpt", "value": None}]})[2] == [("user", "x"), ("assistant", "")]
    assert layouts.turns({"prompt": "a", "response": "b", "score": 3})[1] == "response"
    assert layouts.turns({"other": 1})[1] is None and layouts.turns({})[1] is None
    assert chat.fingerprint(chat.paths({"a": 1, "b": [2]})) == chat.fingerprint(chat.paths({"b": [5, 6], "a": 9}))


def test_mixed_layouts_do_not_stop_the_job(spark):
    deep = "[" * 5000 + "]" * 5000
    say = {"role": "user", "content": "hi"}
    records = [
        {"messages": [say, "oops"]},
        {"messages": [say, {"role": "assistant", "content": ["a", {"type": "text", "text": "b"}]}]},
        {"messages": [{"role": "user", "content": [{"type": "text", "text": "only parts"}]}]},
        {"messages": [say, {"role": "assistant", "content": [{"type": "image", "url": "x"}]}]},
        {"messages": [say, {"role": 3, "content": "x"}]},
        {"messages": [say, {"role": "assistant", "content": {"a": 1}}]},
        {"messages": []},
        {"messages": {"role": "user", "content": "x"}},
        {"prompt": "a", "response": ["b", 1]},
        {"prompt": "\ud800", "response": "b"},
        ["a"],
        3,
        None,
    ]
    import json

    rows = [(i, json.dumps(r)) for i, r in enumerate(records)] + [(50, deep), (51, "{broken"), (52, None), (53, "")]
    got = {r.conv_id: r for r in chat.format_records(spark.createDataFrame(rows, "conv_id long, record string")).collect()}
    assert {i for i, r in got.items() if r.layout} == {1, 2, 9}
    assert chat.parse(got[1].formatted) == [("user", "hi"), ("assistant", "ab")] and chat.parse(got[2].formatted) == [("user", "only parts")]
    assert chat.parse(got[9].formatted)[0] == ("user", "\ufffd")
    assert {r.n_turns for r in chat.read_back(chat.format_records(spark.createDataFrame(rows[:1], "conv_id long, record string"))).collect()} == {0}


URLS = ["http://WWW.Example.COM/en/7?x#y", "https://a.b.example.com/en/8", "http://net/de/", "http://x.example.net/de/81", "http://notexample.com/fr", "http://foo.org/es/1", "http://example.org?es/", "no url", "", None, "x://://y", "http://É.com/en/\n1"]


def test_rules(spark):
    df = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    got = {r.page_id: r for r in url_filter.judge(df).collect()}
    want = [("www.example.com", "/en/7", "example.com/en/7"), ("a.b.example.com", "/en/8", "com/en/"), ("net", "/de/", "net/de/"), ("x.example.net", "/de/81", "example.net/de/8"), ("notexample.com", "/fr", None), ("foo.org", "/es/1", "org/es/")]
    want += [("example.org", "", None), ("", "", None), ("", "", None), ("", "", None), (":", "//y", None), ("É.com", "/en/\n1", "com/en/")]
    assert [(got[i].host, got[i].path, got[i].rule) for i in range(len(URLS))] == want
    assert [got[i].verdict for i in (0, 1, 2, 3, 5)] == ["allow", "block", "allow", "block", "block"]
    assert url_filter.judge(df.limit(0)).count() == 0


def test_trees_learn_held_out_urls(spark):
    rng = random.Random(6)
    bad = [f"http://www.{rng.choice(['cheap-pills', 'free-bets', 'spam-farm'])}.example.net/{rng.choice(['en', 'fr'])}/{rng.randrange(9999)}?a=1&b=2" for _ in range(300)]
    good = [f"https://{''.join(rng.choice('thaneros') for _ in range(8))}.example.com/{rng.choice(['en', 'fr'])}/{rng.randrange(9999)}" for _ in range(900)]
    df = spark.createDataFrame([(u,) for u in bad + good], "url string")
    got = url_filter.judge(df, rules=[]).collect()
    right = sum((r.verdict == "block") == ("-" in r.host) for r in got)
    assert right / len(got) > 0.97


def test_suffix_rates_are_of_all_rows(spark, monkeypatch):
    urls = [f"http://{'spam' if i % 2 else 'good'}{i}.s{i % 40}/x" for i in range(400)] + ["http://one.s1/same"] * 200
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    host, path = url_filter.host_and_path(F.col("url"))
    features = url_filter.with_features(df.withColumns({"host": host, "path": path}))
    for most in (url_filter.MOST_SUFFIXES, 0):  # broadcast, and by shuffle
        monkeypatch.setattr(url_filter, "MOST_SUFFIXES", most)
        _, rates, rate, total = url_filter.fit(features, ["spam"], sample_rows=20)
        assert total == 600 and abs(rate - 201 / 602) < 1e-12
        got = {r.url: r.suffix_rate for r in url_filter.with_rates(features, rates, rate, total).collect()}
        for suffix in range(40):
            mine = [u for u in urls if u.endswith(f".s{suffix}/x") or (suffix == 1 and u.endswith("same"))]
            want = (sum("spam" in u for u in mine) + 20 * rate) / (len(mine) + 20)
            assert all(abs(got[u] - want) < 1e-12 for u in mine)


def test_languages_held_out(spark):
    rng = random.Random(9)
    bags = {"en": ["the", "and", "thing", "wither", "other"], "de": ["der", "und", "nicht", "schein", "über"], "fr": ["les", "est", "leur", "père", "eau"]}
    make = lambda k: " ".join(rng.choice(bags[k]) for _ in range(30))
    train = frame(spark, [(i, make(k), k, "h", 0) for i in range(60) for k in bags])
    langs, table = language_id.train(train)
    rows = [(i * 3 + j, make(k), k if i % 2 else None, f"host{j}", 0) for i in range(20) for j, k in enumerate(bags)]
    odd = [(900, None, "en", "host0", 0), (901, "", "en", "host0", 0), (902, "123 !!", "en", None, 0), (None, make("de"), None, None, 0)]
    got = {r.doc_id: r for r in language_id.identify(language_id.document_evidence(frame(spark, rows + odd)), langs, table).collect()}
    assert all(got[r[0]].lang == list(bags)[r[0] % 3] and got[r[0]].keep for r in rows)
    assert all(got[i].lang == "und" and not got[i].keep for i in (900, 901, 902)) and got[None].lang == "de"
    assert language_id.identify(language_id.document_evidence(frame(spark, [])), langs, table).count() == 0
    assert language_id.train(train.limit(0))[0] == ["und"]


def test_weak_text_takes_the_host_and_declared_language(spark):
    rows = [(i, "the and other thing", "en", "eng.example", 0) for i in range(30)] + [(i + 100, "der und nicht schein", "de", "deu.example", 0) for i in range(30)]
    langs, table = language_id.train(frame(spark, rows))
    weak = [(500, "ok", "de", "deu.example", 0), (501, "ok", "en", "eng.example", 0)]
    got = {r.doc_id: r.lang for r in language_id.identify(language_id.document_evidence(frame(spark, rows + weak)), langs, table).collect()}
    assert got[500] == "de" and got[501] == "en"


def test_page_evidence(spark):
    df = spark.createDataFrame([(1, "http://A.b.Co.de/x", '<!DOCTYPE html><html lang="DE"><script>var x="eng";</script><p>der &amp; die</p>'), (2, None, None)], "page_id long, url string, html string")
    a, b = sorted(language_id.page_evidence(df).collect(), key=lambda r: r.page_id)
    assert (a.declared, a.suffix, a.domain, a.host, a.text.split()) == ("de", "de", "co.de", "a.b.co.de", ["der", "die"])
    assert (b.declared, b.suffix, b.host, b.text) == (None, None, None, "")
