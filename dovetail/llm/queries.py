"""The registered queries of this subpackage, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dovetail.llm import (
    chat,
    common,
    conversation_trie,
    cross_polytope,
    decontamination,
    language_id,
    line_dedup,
    ngram_join,
    packing,
    source_divergence,
    sql,
    suffix_repeats,
    trie_counts,
    url_filter,
    wavelet,
)

#: Tokenizer files, a parameter of the operators.
WORD_BPE = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"
CAPACITY = 2048


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return language_id.identify(language_id.document_evidence(docs), *language_id.train(docs)).drop("th")


def llm_page_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over pages, with markup, suffix and host evidence; trained on documents."""
    trained = language_id.train(common.table(spark, sf_dir, "documents"))
    return language_id.identify(language_id.page_evidence(common.table(spark, sf_dir, "pages")), *trained).drop("th")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_counts.count_tokens(common.table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op3_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_polytope.search(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.new_path(spark, "wavelet")
    wavelet.write_shards(common.table(spark, sf_dir, "documents"), path, public_tokenizers.path(WORD_BPE), end_id=2)
    return wavelet.read_documents(spark, path)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark")).drop("th")


def pack_documents(docs: DataFrame) -> DataFrame:
    pieces = packing.cut_pieces(docs, public_tokenizers.path(WORD_BPE), CAPACITY, end_id=0)
    return common.stash(packing.pack(common.stash(pieces, "pieces"), CAPACITY), "packed")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(common.table(spark, sf_dir, "documents"))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.to_json(F.struct(F.lit(said).alias("prompt"), F.lit(said).alias("response"))).alias("record"))
    records = chat.records_of_turns(common.table(spark, sf_dir, "conversations")).unionByName(extra)
    formatted = common.stash(chat.format_records(records), "formatted")
    return common.stash(chat.read_back(formatted), "read-back").drop("fingerprint")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(common.table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "block_score")


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similarity_classes(common.table(spark, sf_dir, "documents"), width=5, percent=80).select("doc_id", "n_shingles", "component_id")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.remove_repeats(common.table(spark, sf_dir, "documents")).select("doc_id", "text", "kept", "n_removed")


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.conversation_trie(common.table(spark, sf_dir, "conversations"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.divergence(common.table(spark, sf_dir, "documents"))


def op13_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_repeats.digest(suffix_repeats.remove_repeats(common.table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_token_counts,
        op3_cross_polytope,
        op4_token_ids,
        op5_decontamination,
        op6_best_fit_packing,
        op7_chat_formatting,
        op8_url_filter,
        op9_ngram_jaccard_join,
        op10_line_dedup,
        op11_conversation_trie,
        op12_source_divergence,
        op13_suffix_repeats,
        llm_page_languages,
    )
}

SQL: dict[str, str] = {
    "op5_decontamination": sql.DECONTAMINATION,
    "op7_chat_formatting": sql.CHAT,
    "op9_ngram_jaccard_join": sql.JACCARD,
    "op11_conversation_trie": sql.TRIE,
    "op12_source_divergence": sql.DIVERGENCE,
    "op13_suffix_repeats": sql.REPEATS,
}
