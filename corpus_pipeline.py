"""A training corpus from ``documents``: language ID, near duplicates, repeated passages, contamination, packing.

Each stage takes what the one before it kept, whole, and all but the last return the columns of ``documents``, further columns
included. A stage that rejects documents names them by id and text, so rows with null or repeated ids are judged by their
own text, and equal rows alike. Null and empty texts are in no known language and go in the first stage; later stages keep them.
An empty table stays empty. Very long texts are handled whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dovetail.llm import common, decontamination, language_id, line_dedup, ngram_join, queries


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language."""
    found = language_id.identify(language_id.document_evidence(docs), *language_id.train(docs))
    return common.without(docs, found.where(~F.col("keep")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents: that of the smallest id, then of the smallest text hash; a null id comes last.

    Of rows with that id and text, one stays: that whose other columns come first as JSON. Texts without words are linked with nothing.
    """
    found = common.stash(ngram_join.similarity_classes(docs), "classes")
    grouped = common.stash(found.where("n_shingles > 0").groupBy("root", "doc_id", "th").agg(F.count("*").alias("n")), "grouped")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    best = common.stash(grouped.groupBy("root").agg(F.min(order).alias("best"), F.count("*").alias("rows")), "best")
    judged = common.spread_join(grouped, best, ["root"], ["doc_id", "th"], "inner")
    stays = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("th") == F.col("best.th"))
    kept = common.without(docs, judged.where(~stays))
    again = common.stash(judged.where(stays & (F.col("n") > 1)).select("doc_id", "th"), "again")
    if again.isEmpty():
        return kept
    whole = [F.col(common.quoted(c, "k")) for c in docs.columns]
    others = [F.col(common.quoted(c, "k")) for c in docs.columns if c not in ("doc_id", "text")]
    rank = F.to_json(F.struct(*others)) if others else F.lit("")
    rows = common.without(kept, again, "left_semi").alias("k")
    one = rows.groupBy(F.col("k.doc_id").alias("of"), F.xxhash64("k.text").alias("hash")).agg(F.min_by(F.struct(*whole), rank).alias("row"))
    return common.without(kept, again).unionByName(one.select("row.*"))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines and passages that an earlier one, or they themselves further up, have."""
    return line_dedup.cut_texts(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not hold the benchmark."""
    found = decontamination.contamination(docs, common.table(spark, sf_dir, "benchmark"))
    return common.without(docs, found.where("contaminated"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return queries.pack_documents(docs)


STAGES = [
    ("language ID", language),
    ("near duplicates", near_duplicates),
    ("substring dedup", passages),
    ("decontamination", decontaminate),
    ("packing", packed),
]

#: The stages count trigrams, shingles and tokens and solve a packing, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
