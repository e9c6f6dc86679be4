"""Exact, memoised encoding with a tokenizers file.

A text is cut at spaces and newlines. The tokenizer drops white space and never joins what stands on its two
sides, so the ids of a text are the ids of its chunks one after the other, and each distinct chunk is encoded once
and kept. Chunks that are runs of Latin-1 letters go straight to the library's model (its normaliser and splitter
leave them whole); a run of ASCII letters followed by ASCII punctuation other than the apostrophe is the run and
the rest; all others go through the whole library. Texts that may hold special tokens (``<|``) keep their case.
"""

from __future__ import annotations

import json
import re

from tokenizers import Tokenizer

from dovetail.llm import held

#: Fixed value: the splitter pattern of the tokenizer file for which cutting at white space is exact.
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_WORD_AND_MARKS = re.compile(r"([a-z]+)([!-&(-/:-@\[-`{-~][^a-z']*)")


def _pack(ids: list[int]) -> bytes:
    return b"".join([i.to_bytes(4, "little") for i in ids])


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet for the UTF-8 bytes of Latin-1 letters, as a translation of their code points."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, spare = {b: chr(b) for b in visible}, 0x100
    for b in range(0x100):
        if b not in letters:
            letters[b], spare = chr(spare), spare + 1
    return {c: "".join(letters[b] for b in chr(c).encode()) for c in range(0x80, 0x100)}


#: Longer chunks are not kept; what an entry takes besides its letters and ids.
LONG_CHARS, ENTRY_BYTES = 64, 160


class _Memo(dict):
    def __init__(self, tokenizer: Tokenizer):
        self.whole, self.word, self.letters, self.size = tokenizer.encode, tokenizer.model.tokenize, _byte_letters(), 0

    def __missing__(self, chunk: str) -> bytes:
        if chunk.isalpha() and chunk.islower() and chunk < "Ā" and max(chunk) < "Ā":
            made = _pack([t.id for t in self.word(chunk if chunk.isascii() else chunk.translate(self.letters))])
        elif (m := _WORD_AND_MARKS.fullmatch(chunk)) and "<|" not in chunk:
            made = self[m[1]] + self[m[2]]
        else:
            made = _pack(self.whole(chunk, add_special_tokens=False).ids)
        if len(chunk) <= LONG_CHARS:
            self.size += ENTRY_BYTES + len(chunk) + len(made)
            self[chunk] = made
        return made


class ChunkEncoder:
    """Texts to ids as little-endian unsigned 32-bit bytes. ``limit``: bytes of chunks and their ids kept at most."""

    def __init__(self, path: str, limit: int = 96_000_000):
        self.tokenizer = Tokenizer.from_file(path)
        self.limit = limit
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        splits = [x.get("pattern", {}).get("Regex") for x in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        self.chunked = kinds == ["NFC", "Replace", "Lowercase"] and splits[:1] == [SPLIT]
        self.memo = _Memo(self.tokenizer)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.chunked:
            return _pack(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if "<|" not in text:
            try:
                text.encode("latin-1")
                text = text.lower()
            except UnicodeEncodeError:
                pass
        if self.memo.size > self.limit:
            self.memo.clear()
            self.memo.size = 0
        return b"".join(map(self.memo.__getitem__, text.replace("\n", " ").split(" ")))


def worker_encoder(path: str) -> ChunkEncoder:
    """The encoder of this Python worker; it outlives a task."""
    return held.only(f"encoder {path}", lambda: ChunkEncoder(path))
