"""Language identification by Bayesian evidence fusion.

The posterior of each language is the product of

* the text's likelihood under byte trigrams of letters (hashed), tempered because trigrams of one text are not independent,
* the likelihood of the language that the markup declares; how often it is right is counted over all rows,
* the likelihood of the address suffix, from grouped counts,
* a prior of the host: counts of the host, smoothed by those of its registered domain, smoothed by the whole corpus.

All counts of hosts, domains and suffixes are grouped aggregations over every row, of the posterior by text alone. The
languages are those of all labelled rows; the trigrams are trained on about ``SAMPLE_ROWS`` distinct labelled texts, an equal part a
language, in two folds: a text is scored by the fold that has not seen it, so that its own label does not come back as the
text's evidence. Their table has ``BUCKETS`` numbers a language and fold. ``und`` stands for no known language: uniform trigrams
and a small prior. A row is kept if its text has letters and the best language is a known one with a posterior of ``least`` or more.

Null and empty texts, and those without letters, are ``und`` and not kept. Null hosts, suffixes and declared languages
are no evidence. Ties go to the language first by name. Equal rows get equal results. Very long texts are read whole, some
characters at a time. One row a language passes through the driver, and the plan has some columns a language, so labels are to be languages: some
hundreds at most, not free text. Columns made here replace others of their name. An empty table gives no rows; without labelled rows all is ``und``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dovetail.llm import common
from dovetail.llm import held as states

BUCKETS = 1 << 13
SAMPLE_ROWS = 20_000
#: Trigrams a text's evidence counts as at most; share of declared languages that are right, before any are seen; weights of the levels above.
MOST_TRIGRAMS, DECLARED_RIGHT, HOST_WEIGHT, DOMAIN_WEIGHT, UND_PRIOR = 200, 0.9, 20.0, 50.0, 1e-4
FOLDS, PIECE_CHARS = 2, 1 << 20
_CLASS = np.full(256, 0x20, np.uint8)  # letters stay, A-Z in lower case; all else is space
_CLASS[0x61:0x7B] = np.arange(0x61, 0x7B)
_CLASS[0x41:0x5B] = np.arange(0x61, 0x7B)
_CLASS[0x80:] = np.arange(0x80, 0x100)


def buckets(text: str | None) -> np.ndarray:
    """The bucket of each trigram with a letter in it."""
    data = _CLASS[np.frombuffer(f" {text or ''} ".encode("utf-8", "surrogatepass"), np.uint8)].astype(np.uint32)
    a, b, c = data[:-2], data[1:-1], data[2:]
    code = ((a * 0x9E3779B1) ^ (b * 0x85EBCA6B) ^ (c * 0xC2B2AE35)).astype(np.uint32)
    return (code >> np.uint32(19))[(b != 0x20) | ((a != 0x20) & (c != 0x20))]


def pieces(text: str | None) -> Iterator[np.ndarray]:
    """The buckets of a text, ``PIECE_CHARS`` characters at a time; each cut counts as a space."""
    text = text or ""
    for a in range(0, max(1, len(text)), PIECE_CHARS):
        yield buckets(text[a : a + PIECE_CHARS])


def train(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages and, for each of two folds and each language, the log-probabilities of the buckets.

    ``labelled`` (text, lang). The languages are those of all rows, by a grouped count. Each has an equal part of ``sample_rows``, all
    of it if it has fewer, dealt by hash over distinct texts. A fold is trained on the texts of the other one.
    """
    rows = labelled.where("lang is not null and text is not null").select("text", "lang", F.xxhash64("text").alias("th"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row a language
    langs = sorted(sizes)
    table = np.full((FOLDS, len(langs) + 1, BUCKETS), 0.1)
    table[:, -1] = 1
    if langs:
        part = max(1, sample_rows // len(langs))
        share = F.create_map(*(F.lit(x) for lang in langs for x in (lang, int(min(1.0, part / sizes[lang]) * (1 << 20)))))
        dealt = rows.where(F.pmod(F.xxhash64("th"), F.lit(1 << 20)) < share[F.col("lang")])
        sample = dealt.groupBy("lang", "th").agg(F.any_value("text").alias("text")).select("lang", F.pmod("th", F.lit(FOLDS)).alias("fold"), "text")

        def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from dovetail.llm.language_id import BUCKETS, buckets

            total: dict[tuple, np.ndarray] = {}
            for batch in batches:
                for lang, fold, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                    if (lang, fold) not in total:
                        total[lang, fold] = np.zeros(BUCKETS, np.int64)
                    for found in pieces(text.as_py()):
                        total[lang, fold] += np.bincount(found, minlength=BUCKETS)
            for (lang, fold), count in total.items():
                at = np.flatnonzero(count)
                columns = [pa.array([lang] * len(at)), pa.array([fold] * len(at), pa.int64()), pa.array(at), pa.array(count[at])]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "fold", "bucket", "n"])

        found = common.map_arrow(sample, counts, "lang string, fold long, bucket long, n long").groupBy("lang", "fold", "bucket").agg(F.sum("n").alias("n"))
        place = {lang: i for i, lang in enumerate(langs)}
        for r in common.stash(found, "trigrams").collect():  # FOLDS x BUCKETS rows a language at most
            table[1 - r.fold, place[r.lang], r.bucket] += r.n
    return [*langs, "und"], np.log(table / table.sum(2, keepdims=True))


def text_evidence(rows: DataFrame, langs: list[str], table: np.ndarray) -> DataFrame:
    """``rows`` with ``text`` replaced by ``loglik`` (an array by language) and ``letters`` (trigrams); ``row_key`` deals rows to folds."""
    kept = [c for c in rows.columns if c != "text"]
    key = kept.index("row_key")
    held = rows.sparkSession.sparkContext.broadcast(table.transpose(0, 2, 1).astype(np.float32).copy())  # BUCKETS rows a fold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from dovetail.llm.language_id import FOLDS, MOST_TRIGRAMS, pieces

        states.only("none")
        scores = held.value
        for batch in batches:
            loglik, letters = [], []
            for th, text in zip(batch.column(key).to_pylist(), batch.column(len(kept))):
                n, total = 0, np.zeros(scores.shape[2])
                for found in pieces(text.as_py()):
                    n += len(found)
                    total += scores[th % FOLDS][found].sum(0, dtype=np.float64)
                loglik.append(total * (min(n, MOST_TRIGRAMS) / n if n else 0.0))
                letters.append(n)
            columns = [*batch.columns[: len(kept)], pa.array([x.tolist() for x in loglik], pa.list_(pa.float64())), pa.array(letters, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "loglik", "letters"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*kept).schema)
    return common.map_arrow(rows.select(*kept, "text"), run, f"{schema}, loglik array<double>, letters long")


def _all(columns: list[Column], combine: Callable[[Column, Column], Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = combine(out, c)
    return out


def _shares(rows: DataFrame, logs: list[Column], out: str) -> DataFrame:
    """``rows`` with ``out``0, ``out``1, ...: the exponentials of ``logs``, as shares. A step a projection, so that nothing is computed twice."""
    n = range(len(logs))
    rows = rows.withColumns({f"{out}{i}": c for i, c in zip(n, logs)})
    rows = rows.withColumn("_top", _all([F.col(f"{out}{i}") for i in n], lambda a, b: F.greatest(a, b)))
    rows = rows.withColumns({f"{out}{i}": F.exp(F.col(f"{out}{i}") - F.col("_top")) for i in n})
    rows = rows.withColumn("_sum", _all([F.col(f"{out}{i}") for i in n], lambda a, b: a + b))
    return rows.withColumns({f"{out}{i}": F.col(f"{out}{i}") / F.col("_sum") for i in n}).drop("_top", "_sum")


def _best(langs: list[str], of: str) -> tuple[Column, Column]:
    """The language of the largest of the columns ``of``0, ..., the first of equal ones; and its value."""
    columns = [F.col(f"{of}{i}") for i in range(len(langs))]
    top = _all(columns, lambda a, b: F.greatest(a, b))
    return F.coalesce(*(F.when(c == top, F.lit(lang)) for c, lang in zip(columns, langs))), top


def _sums(rows: DataFrame, key: str, size: int) -> DataFrame:
    """For each ``key``, the summed posteriors by text."""
    counts = [F.sum(F.when(F.col("letters") > 0, F.col(f"t{i}")).otherwise(0.0)).alias(f"{key}{i}") for i in range(size)]
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(*counts, F.count("*").alias("rows"))


def identify(rows: DataFrame, langs: list[str], table: np.ndarray, least: float = 0.5) -> DataFrame:
    """lang, confidence, text_lang, keep, th (hash of the text) for ``rows`` (text, declared, suffix, domain, host; others are passed on)."""
    size, n = len(langs), range(len(langs))
    used = {"text", "declared", "suffix", "domain", "host", "lang", "confidence", "text_lang", "keep", "th", "row_key", "loglik", "letters", "salt"}
    made = re.compile(r"(?:[tp]|host|domain|suffix)\d+|_top|_sum")
    passed = [c for c in rows.columns if c not in used and not made.fullmatch(c)]
    evidence = text_evidence(rows.select(*passed, F.xxhash64("text").alias("row_key"), "declared", "suffix", "domain", "host", "text"), langs, table)
    start = [float(np.log(UND_PRIOR if lang == "und" else (1 - UND_PRIOR) / max(1, size - 1))) for lang in langs]
    evidence = common.stash(_shares(evidence, [F.get("loglik", F.lit(i)) + start[i] for i in n], "t"), "evidence")
    has = F.col("letters") > 0
    known = F.col("declared").isin(langs[:-1]) if size > 1 else F.lit(False)
    agrees = _all([F.when(F.col("declared") == lang, F.col(f"t{i}")).otherwise(0.0) for i, lang in enumerate(langs)], lambda a, b: a + b)
    sums = [F.sum(F.when(has, F.col(f"t{i}")).otherwise(0.0)).alias(f"c{i}") for i in n]
    row = evidence.agg(F.sum(F.when(known & has, agrees)).alias("right"), F.count(F.when(known & has, 1)).alias("said"), *sums).first()
    whole = np.array([row[f"c{i}"] or 0.0 for i in n]) + 1.0
    whole = (whole / whole.sum()).tolist()
    # how often what is declared agrees with the text, by all rows that declare a known language; the texts were scored out of fold
    share = ((row.right or 0.0) + 9 * DECLARED_RIGHT) / (row.said + 9)
    right, wrong = float(np.log(share)), float(np.log(max(1e-6, 1 - share) / max(1, size - 2)))
    joined = evidence
    for key in ("host", "domain", "suffix"):
        joined = common.spread_join(joined, common.stash(_sums(evidence, key, size), f"{key}-counts"), [key], ["loglik", "row_key"])

    def smoothed(key: str, above: list[Column], weight: float) -> list[Column]:
        counts = [F.coalesce(F.col(f"{key}{i}"), F.lit(0.0)) for i in n]
        total = _all(counts, lambda a, b: a + b) + weight
        return [(c + weight * p) / total for c, p in zip(counts, above)]

    domain = smoothed("domain", [F.lit(x) for x in whole], DOMAIN_WEIGHT)
    joined = joined.withColumns({f"domain{i}": c for i, c in enumerate(domain)})
    host = smoothed("host", [F.col(f"domain{i}") for i in n], HOST_WEIGHT)
    suffix = smoothed("suffix", [F.lit(x) for x in whole], DOMAIN_WEIGHT)
    logs = []
    for i, lang in enumerate(langs):
        said = F.when(known, F.when(F.col("declared") == lang, right).otherwise(wrong)).otherwise(0.0)
        # how much likelier the suffix is in this language than overall
        address = F.when(F.col("suffix").isNull(), 0.0).otherwise(F.ln(suffix[i] / whole[i]))
        logs.append(F.get("loglik", F.lit(i)) + F.ln(host[i]) + said + address)
    fused = _shares(joined, logs, "p")
    (lang, confidence), (by_text, _) = _best(langs, "p"), _best(langs, "t")
    out = fused.select(
        *passed,
        F.when(has, lang).otherwise("und").alias("lang"),
        F.when(has, confidence).otherwise(0.0).alias("confidence"),
        F.when(has, by_text).otherwise("und").alias("text_lang"),
        F.col("row_key").alias("th"),
    )
    kept = (F.col("lang") != "und") & (F.col("confidence") >= least)
    return common.stash(out.select(*passed, "lang", "confidence", "text_lang", kept.alias("keep"), "th"), "identified")


def document_evidence(docs: DataFrame) -> DataFrame:
    """doc_id, text and the evidence of ``documents``: ``lang`` is what is declared, ``source`` the host; there are no addresses."""
    none = F.lit(None).cast("string")
    return docs.select("doc_id", "text", F.col("lang").alias("declared"), none.alias("suffix"), none.alias("domain"), F.col("source").alias("host"))


def page_evidence(pages: DataFrame) -> DataFrame:
    """page_id, text and the evidence of ``pages``: the html's lang attribute, and suffix, domain and host of the url."""
    host = F.nullif(F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"(?s)^.*?://([^/?#:]*)", 1)), F.lit(""))
    html = F.coalesce("html", F.lit(""))
    text = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"(?s)<[^>]*>|&[a-zA-Z#0-9]+;", " ")
    declared = F.nullif(F.lower(F.regexp_extract(html, r"(?is)<html[^>]*\blang\s*=\s*[\"']?([a-zA-Z]+)", 1)), F.lit(""))
    return pages.select("page_id", text.alias("text"), declared.alias("declared"), F.substring_index(host, ".", -1).alias("suffix"), F.substring_index(host, ".", -2).alias("domain"), host.alias("host"))
