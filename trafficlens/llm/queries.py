"""Registered queries of the dealt operators (SQL twins in ``sql``)."""

from __future__ import annotations

from pyspark.sql import functions as F

from trafficlens.sources.tables import read

from . import (collocations, conversations, decontaminate, html_extract, mixing, pieces, quality, repeats, secret_scan, simhash, sql,
               token_shards, url_filter, vector_dedup)
from .registry import register


@register("op2_source_mix", sql.OP2)
def op2(spark, sf_dir):
    return mixing.mix_report(read(spark, sf_dir, "documents"))


@register("op6_secret_scan", sql.OP6)
def op6(spark, sf_dir):
    return secret_scan.report(read(spark, sf_dir, "documents"))


#: Fixed values of the contract, then the pattern rules that decide where no site rule fits.
SITE_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
PATTERN_RULES = (("block", "/cgi-bin/"), ("block", "/wp-login.php"), ("block", ".adserver."))


@register("op10_url_filter", sql.OP10)
def op10(spark, sf_dir):
    rules = [url_filter.site_rule(*r) for r in SITE_RULES] + [url_filter.pattern_rule(*r) for r in PATTERN_RULES]
    return url_filter.judge_urls(read(spark, sf_dir, "pages", ["page_id", "url"]), rules) \
        .select("page_id", "host", "path", "rule", "verdict")


@register("op5_benchmark_decontamination")
def op5(spark, sf_dir):
    return decontaminate.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@register("op7_simhash_near_dedup")
def op7(spark, sf_dir):
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


@register("op9_quality_classifier")
def op9(spark, sf_dir):
    return quality.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@register("op4_token_shards")
def op4(spark, sf_dir):
    return token_shards.report(read(spark, sf_dir, "documents"))


@register("op8_embedding_near_dedup")
def op8(spark, sf_dir):
    return vector_dedup.near_duplicates(read(spark, sf_dir, "embeddings"))


@register("op1_html_extraction")
def op1(spark, sf_dir):
    return html_extract.extract(read(spark, sf_dir, "pages"))


@register("op3_suffix_dedup")
def op3(spark, sf_dir):
    return repeats.report(read(spark, sf_dir, "documents"))


@register("op11_phrase_collocations", sql.OP11)
def op11(spark, sf_dir):
    return collocations.collocations(read(spark, sf_dir, "documents", ["lang", "text"]))


@register("op12_piece_encoding")
def op12(spark, sf_dir):
    return pieces.report(read(spark, sf_dir, "documents"))


@register("op13_conversation_repair", sql.OP13)
def op13(spark, sf_dir):
    return conversations.report(read(spark, sf_dir, "conversations"))
