"""Token counts by dynamic programming over a trie of pre-tokens.

A pre-token is what stands between white space, with the word mark of the vocabulary before it. The distinct
pre-tokens that a worker has not met are put in a trie, a slice of text at a time. The best (Viterbi) score of a
prefix over all its divisions into pieces depends on the prefix only, so it is computed once at its node, from the
scores of the nodes above; the nodes where pre-tokens end give their counts, which are kept.

The vocabulary file holds merge ranks and no probabilities. A piece of rank r has the unigram log-probability of
Zipf's law, -log(r + 2.7) less the norm. What no piece covers falls back to its UTF-8 bytes, a token each. Equal
scores go to fewer tokens.

A pre-token of more than ``LONG_CHARS`` characters shares little and is not put in the trie: the same scores are taken along it
with only those of the last places held, so its memory does not grow with it.

Null and empty texts, and those of white space only, have no tokens. Repeated rows are counted each; null ids stay null. Other
columns are ignored, and an empty table gives no rows. Texts are handled whole; the words of ``SLICE_CHARS`` characters, or of
one longer text, are held at a time.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from dovetail.llm import common, held

MARK = "▁"
#: Characters of text whose distinct new pre-tokens share one trie, and pre-tokens kept in each of two generations: what a worker holds at most.
SLICE_CHARS, KEPT = 2_000_000, 300_000
#: Longer pre-tokens are counted by themselves.
LONG_CHARS = 256


def zipf_scores(pieces: Iterable[str]) -> dict[str, float]:
    """Log-probabilities for pieces in the order of their rank."""
    pieces = list(pieces)
    norm = math.log(sum(1 / (r + 2.7) for r in range(len(pieces))))
    return {p: -math.log(r + 2.7) - norm for r, p in enumerate(pieces)}


def vocabulary(path: str) -> dict[str, float]:
    """Scores of the pieces of a sentencepiece file, without control, unknown and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    ids.sort(key=lambda i: -model.get_score(i))
    return zipf_scores([model.id_to_piece(i) for i in ids])


class TrieCounter:
    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.byte_score = min(scores.values(), default=0.0) - 10.0
        self.known: dict[str, int] = {}
        self.older: dict[str, int] = {}
        self.nodes = 0

    def insert(self, words: Iterable[str]) -> None:
        """Put ``words`` in a new trie; terminal counts go to ``known``."""
        edges: dict[tuple[int, str], int] = {}
        best, count = [0.0], [0]
        score_of, byte_score, longest = self.scores.get, self.byte_score, self.longest
        for word in words:
            text, node, path = MARK + word, 0, [0]
            for end, letter in enumerate(text, 1):
                child = edges.get((node, letter))
                if child is None:
                    # the score of this prefix: the best of the prefixes above, each with the piece that is left
                    width = len(letter.encode("utf-8", "surrogatepass"))
                    top, fewest = best[node] + byte_score * width, count[node] + width
                    for start in range(max(0, end - longest), end):
                        s = score_of(text[start:end])
                        if s is not None:
                            at = path[start]
                            s += best[at]
                            if s > top or s == top and count[at] + 1 < fewest:
                                top, fewest = s, count[at] + 1
                    child = edges[node, letter] = len(best)
                    best.append(top)
                    count.append(fewest)
                node = child
                path.append(node)
            self.known[word] = count[node]
        self.nodes = len(best)

    def long_count(self, word: str) -> int:
        """The count of one long pre-token."""
        best, count = deque([0.0], self.longest), deque([0], self.longest)  # of the last places, the latest last
        text, score_of = MARK + word, self.scores.get
        for end, letter in enumerate(text, 1):
            width = len(letter.encode("utf-8", "surrogatepass"))
            top, fewest = best[-1] + self.byte_score * width, count[-1] + width
            held = len(best)
            for back in range(held, 0, -1):
                s = score_of(text[end - back : end])
                if s is not None:
                    s += best[held - back]
                    if s > top or s == top and count[held - back] + 1 < fewest:
                        top, fewest = s, count[held - back] + 1
            best.append(top)
            count.append(fewest)
        return count[-1]

    def counts(self, texts: list[str]) -> list[tuple[int, int]]:
        """Pre-tokens and tokens of each text."""
        out: list[tuple[int, int]] = []
        at = 0
        while at < len(texts):
            held, size = [], 0
            while at < len(texts) and (not held or size < SLICE_CHARS):
                held.append(texts[at].split())
                size += len(texts[at])
                at += 1
            new: set[str] = set()
            for words in held:
                new.update(words)
            if len(self.known) > KEPT:  # words that are met again move up; the others of the older generation go
                self.older, self.known = self.known, {}
            new.difference_update(self.known)
            again = new.intersection(self.older)
            self.known.update(zip(again, map(self.older.__getitem__, again)))
            new.difference_update(again)
            long = {w: self.long_count(w) for w in new if len(w) > LONG_CHARS}
            new.difference_update(long)
            self.insert(new)
            get = self.known.__getitem__
            for words in held:
                out.append((len(words), sum(long[w] if w in long else get(w) for w in words) if long else sum(map(get, words))))
        return out


def worker_counter(path: str) -> TrieCounter:
    return held.only(f"counter {path}", lambda: TrieCounter(vocabulary(path)))


def count_tokens(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_pretokens, n_tokens for every row of ``docs`` (doc_id, text). No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from dovetail.llm.trie_counts import worker_counter

        counter = worker_counter(model_path)
        for batch in batches:
            pairs = counter.counts([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([p for p, _ in pairs], pa.int64()), pa.array([t for _, t in pairs], pa.int64())], names=["doc_id", "n_pretokens", "n_tokens"])

    return common.stash(common.map_arrow(docs.select("doc_id", "text"), run, "doc_id long, n_pretokens long, n_tokens long"), "token-counts")
