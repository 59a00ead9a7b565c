"""Queries over the test tables, whole tables and whole texts, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.llm import contamination, distinctive_terms, languages, mixing, pair_defects, rank_fusion, sentences, shared_spans, splitting
from docweft.llm._util import chunk_and_answer_records, record_texts, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return distinctive_terms.concentrated_terms(distinctive_terms.term_scores(chunk_and_answer_records(spark, d)))


def p1_ranked_terms(spark: SparkSession, d: str) -> DataFrame:
    s = distinctive_terms.ranked_terms(distinctive_terms.term_scores(chunk_and_answer_records(spark, d)))
    return s.select("rec_table", "rec_id", F.col("rank").cast("long").alias("rank"), "term", F.col("tf").cast("long").alias("tf"), "df", F.round("score", 4).alias("score"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return rank_fusion.outvoted_winners(table(spark, d, "hits"))


def p2_fused(spark: SparkSession, d: str) -> DataFrame:
    return rank_fusion.fuse(table(spark, d, "hits"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans.shared_spans(chunk_and_answer_records(spark, d)).where("shared_chars > 0").select("rec_table", "rec_id")


def p3_shared(spark: SparkSession, d: str) -> DataFrame:
    s = shared_spans.shared_spans(chunk_and_answer_records(spark, d))
    return s.withColumn("shared_share", F.when(F.col("n_chars") > 0, F.round(F.col("shared_chars") / F.col("n_chars"), 4)).otherwise(F.lit(0.0)))


def _defects(spark: SparkSession, d: str) -> DataFrame:
    return pair_defects.pair_defects(table(spark, d, "answers"), languages.learn(table(spark, d, "documents")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _defects(spark, d).where("main is not null").select("answer_id", F.col("main").alias("defect"))


def p4_all_defects(spark: SparkSession, d: str) -> DataFrame:
    return _defects(spark, d).select("answer_id", F.explode("defects").alias("defect"))


def _splittable(spark: SparkSession, d: str) -> DataFrame:
    """Oversized texts of chunks and of the chunks inside extracted documents, each once; rows without an id are left out."""
    c = table(spark, d, "chunks").select(F.lit("chunks").alias("rec_table"), F.col("chunk_pos").cast("string").alias("rec_id"), "text", "section")
    x = (table(spark, d, "extracted_docs").where("sha256 is not null").select("sha256", F.posexplode("chunks").alias("ordinal", "c"))
         .select(F.lit("extracted_docs").alias("rec_table"), F.concat_ws(":", "sha256", F.col("ordinal").cast("string")).alias("rec_id"), F.col("c.text").alias("text"), F.lit(None).cast("string").alias("section")))
    return record_texts(c.unionByName(x), ["rec_table", "rec_id"], "text", splitting.token_estimate(F.length("text")) > splitting.LIMIT, {"section": F.min("section")})


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    pieces = splitting.split_oversized(_splittable(spark, d))
    return pieces.where("piece_no = 0").select("rec_table", "rec_id", "cut_kind")


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(_splittable(spark, d)).select("rec_table", "rec_id", "section", "piece_no", "char_start", "core_start", "char_end", "n_tokens", "cut", "cut_kind", "piece")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    leaks = contamination.find_leaks(table(spark, d, "documents"), table(spark, d, "heldout_items"))
    return contamination.leaked_pairs(leaks).select("item_id", "doc_id")


def p6_decontaminated(spark: SparkSession, d: str) -> DataFrame:
    leaks = contamination.find_leaks(table(spark, d, "documents"), table(spark, d, "heldout_items"))
    return leaks.select("doc_id", "n_words", "matched_words", _n_items(), "removed_words", "cleaned")


def p6_extent(spark: SparkSession, d: str) -> DataFrame:
    leaks = contamination.find_leaks(table(spark, d, "documents"), table(spark, d, "heldout_items"))
    return leaks.select("doc_id", "n_words", "matched_words", _n_items())


def _n_items():
    return F.size(F.array_distinct(F.transform("leaks", lambda x: x["item_id"]))).alias("n_items")


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets")).select("doc_id", F.col("mix_source").alias("source"), "copy_no", "text")


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.source_rates(table(spark, d, "documents"), table(spark, d, "mix_targets")).select(
        "source", "target_share", "max_repeats", "n_docs", "n_tokens", F.round("rate", 6).alias("rate"), "mixed_tokens", F.round("actual_share", 6).alias("actual_share"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentence_ends(table(spark, d, "documents")).select("doc_id", "end_pos")


def p8_sentences(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    return sentences.sentence_ends(docs).select("doc_id", "sent_no", "char_start", "end_pos")


QUERIES = {f.__name__: f for f in (p1_found, p1_ranked_terms, p2_found, p2_fused, p3_found, p3_shared, p4_found, p4_all_defects,
                                   p5_found, p5_pieces, p6_found, p6_decontaminated, p6_extent, p7_mixture, p7_shares, p8_found, p8_sentences)}
