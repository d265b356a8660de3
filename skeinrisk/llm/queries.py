"""Queries over the driver's tables, one for each operator of this subpackage."""

from __future__ import annotations

from . import decontaminate, licenses, mixing, periodic_runs, quality, sharding, simhash, spelling, substring_dedup, suffix_family, topk, url_filter, warc
from .common import table


def op1_decontaminate(spark, sf_dir):
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_substring_dedup(spark, sf_dir):
    return substring_dedup.repeated_spans(table(spark, sf_dir, "documents"))


def op3_url_filter(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


def op4_mixing(spark, sf_dir):
    return mixing.mix_digest(table(spark, sf_dir, "documents"))


def op5_sharding(spark, sf_dir):
    return sharding.shard_digest(table(spark, sf_dir, "documents"))


def op6_simhash(spark, sf_dir):
    return simhash.simhash_digest(table(spark, sf_dir, "documents"))


def op7_warc(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op8_quality(spark, sf_dir):
    return quality.quality_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_topk(spark, sf_dir):
    return topk.top_k_digest(table(spark, sf_dir, "embeddings"))


def op10_licenses(spark, sf_dir):
    return licenses.license_digest(table(spark, sf_dir, "documents"))


def op11_suffix_family(spark, sf_dir):
    return suffix_family.suffix_digest(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark, sf_dir):
    return periodic_runs.runs_digest(table(spark, sf_dir, "documents"))


def op13_spelling(spark, sf_dir):
    return spelling.spelling_digest(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_substring_dedup, op3_url_filter, op4_mixing, op5_sharding, op6_simhash, op7_warc, op8_quality, op9_topk, op10_licenses, op11_suffix_family, op12_periodic_runs, op13_spelling)}

ORACLE_SQL = {"op9_topk": topk.ORACLE, "op10_licenses": licenses.oracle()}
