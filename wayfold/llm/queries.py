"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, decontaminate, jaccard_join, katz, line_dedup, quality_rules, suffix_dedup, toxicity, url_filter, warc


def pipeline(spark, sf_dir: str):
    """The repository's corpus pipeline over documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "pipeline": pipeline,
        "op1_quality_rules": quality_rules.query,
        "op2_katz": katz.query,
        "op3_url_filter": url_filter.query,
        "op4_bpe": bpe.query,
        "op5_suffix_dedup": suffix_dedup.query,
        "op6_toxicity": toxicity.query,
        "op7_warc": warc.query,
        "op8_jaccard_join": jaccard_join.query,
        "op9_line_dedup": line_dedup.query,
        "op10_decontaminate": decontaminate.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": quality_rules.SQL,
        "op3_url_filter": url_filter.SQL,
        "op7_warc": warc.SQL,
        "op8_jaccard_join": jaccard_join.SQL,
        "op9_line_dedup": line_dedup.SQL,
        "op10_decontaminate": decontaminate.SQL,
    }
