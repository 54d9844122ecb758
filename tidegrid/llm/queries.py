"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from tidegrid.llm import decontamination, lm_scoring, near_duplicates, quality_classifier, quality_rules, repeated_windows, secret_scans, sentence_pieces, toxicity, url_filters
from tidegrid.sources import table


def op1_quality_rules(spark, sf_dir):
    return quality_rules.op1_query(table(spark, sf_dir, "documents"))


def op3_url_filters(spark, sf_dir):
    return url_filters.op3_query(table(spark, sf_dir, "pages"))


def op5_secret_scans(spark, sf_dir):
    return secret_scans.op5_query(table(spark, sf_dir, "documents"))


def op10_sentence_pieces(spark, sf_dir):
    return sentence_pieces.op10_query(table(spark, sf_dir, "documents"))


def op9_decontamination(spark, sf_dir):
    return decontamination.op9_query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_near_duplicates(spark, sf_dir):
    return near_duplicates.op8_query(table(spark, sf_dir, "documents"))


def op6_repeated_windows(spark, sf_dir):
    return repeated_windows.op6_query(table(spark, sf_dir, "documents"))


def op7_toxicity(spark, sf_dir):
    return toxicity.op7_query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_quality_classifier(spark, sf_dir):
    return quality_classifier.op2_query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_lm_scoring(spark, sf_dir):
    return lm_scoring.op4_query(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op3_url_filters": op3_url_filters,
    "op5_secret_scans": op5_secret_scans,
    "op10_sentence_pieces": op10_sentence_pieces,
    "op9_decontamination": op9_decontamination,
    "op8_near_duplicates": op8_near_duplicates,
    "op6_repeated_windows": op6_repeated_windows,
    "op7_toxicity": op7_toxicity,
    "op2_quality_classifier": op2_quality_classifier,
    "op4_lm_scoring": op4_lm_scoring,
}

SQL = {
    "op1_quality_rules": quality_rules.SQL,
    "op3_url_filters": url_filters.SQL,
    "op5_secret_scans": secret_scans.sql(),
    "op6_repeated_windows": repeated_windows.SQL,
    "op8_near_duplicates": near_duplicates.SQL,
    "op9_decontamination": decontamination.SQL,
}
