"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing columns, and brute-force versions."""

from __future__ import annotations

import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
_SYLLABLES = ["an", "er", "the", "on", "tion", "re", "st", "ou", "ver", "ein", "ich", "que", "ado", "ción", "eau", "é"]


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice(_SYLLABLES) for _ in range(rng.randrange(1, 5))) for _ in range(n)]


def prose(rng: random.Random, n: int) -> str:
    out = []
    for i, w in enumerate(words(rng, n)):
        out.append(w.capitalize() if i % 9 == 0 else w + "." if i % 9 == 8 else w)
    return " ".join(out)


def documents(seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    base = [prose(rng, rng.randrange(3, 120)) for _ in range(30)]
    near = base[3].split(" ")
    near[5] = "changed"
    passage = prose(rng, 70)
    texts = [*base, base[3], " ".join(near), base[7].upper(), base[3] + "  ", None, "", "  \n", "one", "İstanbul Σας <|endoftext|> x", prose(rng, 9000), f"{base[1]} {passage} {base[2]}", f"{base[4]} {passage} {base[5]}", "same\nsame\n" * 20]
    rows = [(i * 3, t, "en" if i % 2 else "fr", f"src{i % 3}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[2], (None, base[9], None, None, None), (9, base[11], "en", "src1", 1)]


def frame(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def lower_ascii(t: str | None) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def shingle_set(text: str | None, width: int = 5) -> frozenset:
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", lower_ascii(text)) if x]
    if len(w) < width:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1))


def link_classes(texts: list[str | None], percent: int = 80) -> list[int]:
    """The component of each text, by all pairs."""
    sets = [shingle_set(t) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]
