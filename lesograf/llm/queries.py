"""Queries pN_... over the tables of one data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lesograf.llm import confusables, consensus, encoding, langid, mixing, packing, quality, sentences, splitting, termfreq
from lesograf.sources.tables import read_table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    pieces = splitting.split_oversized(read_table(spark, folder, "sentences"))
    return pieces.where("oversized AND piece = 0").select("sent_key")


def p1_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.split_oversized(read_table(spark, folder, "sentences"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return p2_quality(spark, folder).where("NOT prose").select("sent_key")


def p2_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality(read_table(spark, folder, "sentences"), read_table(spark, folder, "word_forms"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    counts = termfreq.term_frequencies(read_table(spark, folder, "treebank_tokens"), read_table(spark, folder, "sentences"))
    return counts.where("mark IS NOT NULL").select("field", "term", "mark")


def p3_frequencies(spark: SparkSession, folder: str) -> DataFrame:
    return termfreq.term_frequencies(read_table(spark, folder, "treebank_tokens"), read_table(spark, folder, "sentences"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return confusables.look_alikes(read_table(spark, folder, "treebank_tokens"), read_table(spark, folder, "word_forms"))


def p4_normal_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return confusables.normal_tokens(read_table(spark, folder, "treebank_tokens"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return sentences.sentence_units(read_table(spark, folder, "raw_texts")).select("text_id", "start_char", "end_char")


def p5_units(spark: SparkSession, folder: str) -> DataFrame:
    return sentences.sentence_units(read_table(spark, folder, "raw_texts"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return p6_restored(spark, folder).select("record_type", "record_key")


def p6_restored(spark: SparkSession, folder: str) -> DataFrame:
    return encoding.garbled_records(*(read_table(spark, folder, t) for t in ("sentences", "treebank_tokens", "word_forms")))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    labels, _ = consensus.consensus(read_table(spark, folder, "annotations"))
    return labels.select("tok_key", "field", "label")


def p7_labels(spark: SparkSession, folder: str) -> DataFrame:
    return consensus.consensus(read_table(spark, folder, "annotations"))[0]


def p7_annotators(spark: SparkSession, folder: str) -> DataFrame:
    return consensus.consensus(read_table(spark, folder, "annotations"))[1]


def p8_windows(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(read_table(spark, folder, "documents"))


def p8_certificate(spark: SparkSession, folder: str) -> DataFrame:
    return packing.certificate(packing.pack(read_table(spark, folder, "documents")))


def p9_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(read_table(spark, folder, "documents"), read_table(spark, folder, "mix_targets"))[0]


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(read_table(spark, folder, "documents"), read_table(spark, folder, "mix_targets"))[1]


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return langid.found_languages(read_table(spark, folder, "documents"))


def p10_segments(spark: SparkSession, folder: str) -> DataFrame:
    return langid.segments(read_table(spark, folder, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1].isdigit()}
