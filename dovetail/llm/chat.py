"""Chat formatting: records of unlike layouts are told by the fingerprint of their field paths.

The nested field paths of a record (types and array marks, no values) are hashed; the hash selects a declarative
mapping to canonical turns (role, text). A record with further fields takes the mapping whose paths it has most of.
The template marks each turn by its role. Control strings inside texts get an escape after their first character and
escapes are doubled, so what stands between marks is read back exactly. The loss mask is a list of spans in the
formatted text, in code points, over the assistant's texts.

Null texts and roles are empty. Turns stand in the order of turn, role, text (nulls first), repeated rows as often as they
stand. Texts that are lists of parts (some text, or an object with a ``text``) are the parts one after the other. Records that
several mappings fit take that with the most paths, of equal ones the first by name, and what that does not name is left out. Records that
no mapping fits give no turns and a null layout: broken or very deep JSON, no messages at all, and any message that is no
object, has a role that is no text, or a text that is neither text nor parts. Very long texts are handled whole; a conversation is
one row, so all of it is held at a time. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dovetail.llm import common

#: Each mapping: its name, the list of messages with the fields of role and text, or the fields with the roles they stand for.
MAPPINGS = [
    {"name": "messages", "each": "messages", "role": "role", "text": "content"},
    {"name": "shared", "each": "conversations", "role": "from", "text": "value", "rename": True},
    {"name": "dialogue", "each": "dialogue", "role": "speaker", "text": "text", "rename": True},
    {"name": "completion", "fields": [("prompt", "user"), ("completion", "assistant")]},
    {"name": "response", "fields": [("prompt", "user"), ("response", "assistant")]},
    {"name": "system response", "fields": [("system", "system"), ("prompt", "user"), ("response", "assistant")]},
    {"name": "instruction", "fields": [("instruction", "user"), ("output", "assistant")]},
    {"name": "instruction input", "fields": [(("instruction", "input"), "user"), ("output", "assistant")]},
    {"name": "question", "fields": [("question", "user"), ("answer", "assistant")]},
]
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": ("<s> ", " </s>"), "system": ("<<SYS>> ", " <</SYS>>")}
OTHER = ("[ROLE] ", " [:] ", " [/ROLE]")
CONTROL = ["[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[ROLE]", "[:]", "[/ROLE]"]
_ESCAPE = "\\"
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_ESCAPED = re.compile(r"\\(\\?)")
_TURN = re.compile(r"\[INST\] (.*?) \[/INST\]|<s> (.*?) </s>|<<SYS>> (.*?) <</SYS>>|\[ROLE\] (.*?) \[:\] (.*?) \[/ROLE\]", re.S)


def paths(record, at: str = "") -> set[str]:
    """The nested field paths of a record, with the kind at each leaf."""
    if isinstance(record, dict):
        return set().union(*(paths(v, f"{at}.{k}" if at else str(k)) for k, v in record.items()))
    if isinstance(record, list):
        return set().union({f"{at}[]"}, *(paths(v, f"{at}[]") for v in record))
    return {f"{at}:text" if record is None or isinstance(record, str) else f"{at}:{type(record).__name__}"}


def fingerprint(found: set[str]) -> str:
    return hashlib.blake2b("\n".join(sorted(found)).encode(), digest_size=8).hexdigest()


def _mapping_paths(m: dict) -> set[str]:
    if "each" in m:
        return {f"{m['each']}[]", f"{m['each']}[].{m['role']}:text", f"{m['each']}[].{m['text']}:text"}
    return {f"{f}:text" for field, _ in m["fields"] for f in ([field] if isinstance(field, str) else field)}


class Unfit(ValueError):
    """A record has the paths of a mapping, but also other kinds at the same places."""


def _text(value) -> str:
    """A text; null is empty, and a list of parts is their texts one after the other. Half of a surrogate pair is replaced."""
    if value is None:
        return ""
    if isinstance(value, str):
        return value if value.isascii() else value.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    if isinstance(value, list):
        parts = [p.get("text") if isinstance(p, dict) and p.get("type", "text") == "text" and "text" in p else p for p in value]
        if all(isinstance(p, str) for p in parts):
            return "".join(map(_text, parts))
    raise Unfit


class Layouts:
    """Mappings by the fingerprint of their paths."""

    def __init__(self, mappings: list[dict] = MAPPINGS):
        self.exact = {fingerprint(_mapping_paths(m)): m for m in mappings}
        self.others = sorted(((_mapping_paths(m), m) for m in mappings), key=lambda x: (-len(x[0]), x[1]["name"]))
        self.by_print: dict[str, dict | None] = {}

    def select(self, record) -> tuple[str, dict | None]:
        found = paths(record)
        key = fingerprint(found)
        if key in self.exact:
            return key, self.exact[key]
        if key not in self.by_print:
            if len(self.by_print) > 10_000:
                self.by_print.clear()
            plain = {re.sub(r"^(\w+\[\]\.\w+)\[\](\.text)?:text$", r"\1:text", p) for p in found}  # of a text in parts
            self.by_print[key] = next((m for need, m in self.others if need <= found | plain), None)
        return key, self.by_print[key]

    def turns(self, record) -> tuple[str, str | None, list[tuple[str, str]]]:
        """Fingerprint, name of the mapping and canonical turns of a record; no name and no turns where none fits all of it."""
        try:
            key, m = self.select(record)
        except RecursionError:
            return fingerprint({"too deep"}), None, []
        if m is None:
            return key, None, []
        try:
            return key, m["name"], self._mapped(record, m)
        except Unfit:
            return key, None, []

    @staticmethod
    def _mapped(record, m: dict) -> list[tuple[str, str]]:
        if not isinstance(record, dict):
            raise Unfit
        out = []
        if "each" in m:
            rename = ROLES if m.get("rename") else {}
            messages = record.get(m["each"])
            if not isinstance(messages, list) or not all(isinstance(x, dict) and isinstance(x.get(m["role"]), str | None) for x in messages):
                raise Unfit
            for x in messages:
                role = _text(x.get(m["role"]))
                out.append((rename.get(role, role), _text(x.get(m["text"]))))
            return out
        for field, role in m["fields"]:
            texts = [_text(record.get(f)) for f in ([field] if isinstance(field, str) else field)]
            out.append((role, "\n\n".join(t for i, t in enumerate(texts) if t or i == 0)))
        return out


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + _ESCAPE + m[0][1:], text.replace(_ESCAPE, _ESCAPE * 2))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the loss mask: (start, end) of each assistant text in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        before, after = MARKS.get(role) or (OTHER[0] + escape(role) + OTHER[1], OTHER[2])
        body = escape(text)
        parts += [before, body, after]
        if role == "assistant":
            spans.append((at + len(before), at + len(before) + len(body)))
        at += len(before) + len(body) + len(after)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    out = []
    at = 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError(f"no turn at {at}")
        at = m.end()
        user, assistant, system, role, text = m.groups()
        kind = "user" if user is not None else "assistant" if assistant is not None else "system" if system is not None else unescape(role)
        out.append((kind, unescape(next(t for t in (user, assistant, system, text) if t is not None))))
    if at != len(formatted):
        raise ValueError(f"no turn at {at}")
    return out


def records_of_turns(rows: DataFrame) -> DataFrame:
    """conv_id and a JSON record of messages for each conversation of ``rows`` (conv_id, turn, role, text)."""
    message = F.struct("turn", "role", "text")
    ordered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(message)).alias("m"))
    messages = F.transform("m", lambda x: F.struct(F.coalesce(x["role"], F.lit("")).alias("role"), F.coalesce(x["text"], F.lit("")).alias("content")))
    return ordered.select("conv_id", F.to_json(F.struct(messages.alias("messages"))).alias("record"))


def format_records(records: DataFrame) -> DataFrame:
    """conv_id, fingerprint, layout, formatted, loss (spans) of every row of ``records`` (conv_id, record: JSON)."""
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from dovetail.llm.chat import Layouts, render

        layouts = Layouts()
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                try:
                    record = json.loads(text) if text else {}
                except (ValueError, RecursionError):
                    record = {}
                key, name, turns = layouts.turns(record)
                formatted, spans = render(turns)
                rows.append((key, name, formatted if name else None, [{"start": a, "end": b} for a, b in spans]))
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.string(), spans_type)))], names=["conv_id", "fingerprint", "layout", "formatted", "loss"])

    return common.map_arrow(records.select("conv_id", "record"), run, "conv_id long, fingerprint string, layout string, formatted string, loss array<struct<start:long,end:long>>")


def read_back(formatted: DataFrame) -> DataFrame:
    """Counts and digests of each conversation, from its formatted text and loss mask alone."""
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from dovetail.llm.chat import parse, unescape

        sha = lambda t: hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest()
        for batch in batches:
            rows = []
            for text, loss in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                text = text or ""
                turns = parse(text)
                learnt = "".join(unescape(text[x["start"] : x["end"]]) for x in loss)
                rows.append((len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(learnt), sha(learnt), len(text)))
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds)), batch.column(1), batch.column(2)], names=["conv_id", *names, "fingerprint", "layout"])

    return common.map_arrow(formatted.select("conv_id", "fingerprint", "layout", "formatted", "loss"), run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, fingerprint string, layout string")
