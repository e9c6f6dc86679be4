"""Word shingles of many texts at once, as 64-bit hashes, without a loop over words.

A word's hash is a difference of prefix sums of a polynomial over the bytes, brought to the word's start, mixed with
its length; a shingle's hash mixes those of its words with one odd factor for each place. Texts with fewer words
than a shingle make one shingle of all their words, told apart by their number. A very long text is taken in pieces
that share the words of a shingle but one, so what is held besides its set is bounded.
"""

from __future__ import annotations

import hashlib

import numpy as np

from dovetail.llm import held

#: Bytes that separate words: space and U+0009 to U+000D. Only A-Z change case.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
#: Bytes of one text that are hashed at a time.
PIECE_BYTES = 4_000_000
_U = np.uint64
BASE = 0x9E3779B97F4A7C15
_PLACE = [0xD6E8FEB86659FD93, 0xA5A3564E27F886B5, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def powers(n: int, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, n at least; kept while they are of usual size."""
    known = held.only("powers", dict)
    made = known.get(base)
    if made is None or len(made[0]) < n:
        made = []
        for b in (base, pow(base, -1, 1 << 64)):
            factors = np.full(n, _U(b))
            factors[0] = 1
            with np.errstate(over="ignore"):
                made.append(factors.cumprod(dtype=np.uint64))
        made = tuple(made)
        if n <= 2 * PIECE_BYTES:
            known[base] = made
    return made


def prefix_sums(values: np.ndarray, base: int = BASE) -> np.ndarray:
    """Sums of ``values`` times the powers of ``base``, before each place and after the last."""
    with np.errstate(over="ignore"):
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * powers(len(values) + 1, base)[0][: len(values)], dtype=np.uint64)])


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASE) -> np.ndarray:
    """A hash of what stands from each start to its end, wherever it stands; ``sums``: of ``prefix_sums``."""
    with np.errstate(over="ignore"):
        return mix((sums[ends] - sums[starts]) * powers(len(sums), base)[1][starts] + (ends - starts).astype(np.uint64) * _U(0xD1B54A32D192ED03))


def _hash(raw: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    n_texts = len(raw)
    data = LOWER[np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)]
    limits = np.cumsum([0, *(len(x) + 1 for x in raw)])
    space = SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edge[0::2], edge[1::2]
    text_of = np.searchsorted(limits, starts, "right") - 1
    words = span_hashes(prefix_sums(data.astype(np.uint64) + _U(1)), starts, ends)
    with np.errstate(over="ignore"):
        n_words = np.bincount(text_of, minlength=n_texts) if len(text_of) else np.zeros(n_texts, np.int64)
        first = np.concatenate([[0], np.cumsum(n_words)])
        parts = []
        if len(words) >= width:
            last = len(words) - width + 1
            whole = np.flatnonzero(text_of[:last] == text_of[width - 1 :])
            made = np.zeros(len(whole), np.uint64)
            for k in range(width):
                made += mix(words[whole + k] * _U(_PLACE[k % 5] + 2 * (k // 5)))
            parts.append((text_of[whole], mix(made)))
        short = np.flatnonzero((n_words > 0) & (n_words < width))
        if len(short):
            made = n_words[short].astype(np.uint64) * _U(0x8CB92BA72F3D8DD7)
            for k in range(width - 1):
                has = n_words[short] > k
                made[has] += mix(words[first[short[has]] + k] * _U(_PLACE[k % 5] + 2 * (k // 5)))
            parts.append((short, mix(made ^ _U(0x5851F42D4C957F2D))))
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(n_texts + 1, np.int64)
    text_of, hashes = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((hashes, text_of))
    text_of, hashes = text_of[order], hashes[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text_of[1:] != text_of[:-1])
    text_of, hashes = text_of[new], hashes[new]
    return hashes, np.searchsorted(text_of, np.arange(n_texts + 1))


def _long(raw: bytes, width: int) -> np.ndarray:
    """The shingles of one very long text, piece by piece."""
    found, at, size = np.zeros(0, np.uint64), 0, PIECE_BYTES
    while at < len(raw):
        # a piece ends at white space and the next begins width - 1 words before that
        end = at + size
        while end < len(raw) and not SPACE[raw[end]]:
            end += 1
        piece = raw[at:end]
        back = piece.split()[1 - width :] if end < len(raw) and width > 1 else []
        if end < len(raw) and len(back) < max(1, width - 1):
            size *= 2  # few words in so many bytes
            continue
        found = np.union1d(found, _hash([piece], width)[0])
        if end >= len(raw):
            break
        step = len(piece)
        for word in reversed(back):
            step = piece.rindex(word, 0, step)
        if step == 0:
            size *= 2
            continue
        at, size = at + step, PIECE_BYTES
    return found


def hash_shingles(texts: list[str | None], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, text by text and ascending within each; and where each text's begin (one more entry than texts)."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    if not raw:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    long = {i: _long(r, width) for i, r in enumerate(raw) if len(r) > PIECE_BYTES}
    if not long:
        return _hash(raw, width)
    hashes, at = _hash([b"" if i in long else r for i, r in enumerate(raw)], width)
    sets = [long.get(i, hashes[at[i] : at[i + 1]]) for i in range(len(raw))]
    return np.concatenate(sets), np.cumsum([0, *map(len, sets)])


def set_digest(hashes: np.ndarray) -> bytes:
    """A 128-bit digest of a set of shingles."""
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()
