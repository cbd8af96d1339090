"""The registered queries of the training-data operators: thin, over whole tables."""

from __future__ import annotations

from . import decontaminate, mixing, neighbours, ngram, perspectives, quality, sentences, styletree, suffixes
from .simhash import near_duplicates


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffixes(spark, sf_dir):
    return suffixes.dedupe_report(table(spark, sf_dir, "documents"))


def op2_quality(spark, sf_dir):
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_styletree(spark, sf_dir):
    return styletree.main_text(table(spark, sf_dir, "pages"))


def op4_decontaminate(spark, sf_dir):
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_ngram(spark, sf_dir):
    return ngram.score(table(spark, sf_dir, "documents"), whole=True)


def op6_perspectives(spark, sf_dir):
    return perspectives.rotate(table(spark, sf_dir, "conversations"))


def op7_simhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_mix(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_neighbours(spark, sf_dir):
    return neighbours.every_hundredth(table(spark, sf_dir, "embeddings"))


def op10_sentences(spark, sf_dir):
    return sentences.dedupe(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_suffixes, op2_quality, op3_styletree, op4_decontaminate, op5_ngram, op6_perspectives, op7_simhash, op8_mix, op9_neighbours, op10_sentences)}
ORACLE = {"op1_suffixes": suffixes.ORACLE, "op4_decontaminate": decontaminate.ORACLE, "op6_perspectives": perspectives.ORACLE, "op8_mix": mixing.ORACLE}
