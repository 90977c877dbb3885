"""The numbered operators as queries of (spark, sf_dir), and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chatformat, collocations, decontaminate, linededup, merkle, packing, pii, secrets, simhash, substrings, topk, toxicity, urlfilter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_scan": secrets.op1,
        "op2_pii": pii.op2,
        "op3_packing": packing.op3,
        "op4_line_dedup": linededup.op4,
        "op5_toxicity": toxicity.op5,
        "op6_decontamination": decontaminate.op6,
        "op7_suffix_dedup": substrings.op7,
        "op8_simhash_near_dedup": simhash.op8,
        "op9_url_filter": urlfilter.op9,
        "op10_top_k": topk.op10,
        "op11_collocations": collocations.op11,
        "op12_merkle_manifest": merkle.op12,
        "op13_chat_format": chatformat.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op6_decontamination": decontaminate.ORACLE_SQL,
        "op9_url_filter": urlfilter.ORACLE_SQL,
        "op10_top_k": topk.ORACLE_SQL,
        "op11_collocations": collocations.ORACLE_SQL,
        "op12_merkle_manifest": merkle.ORACLE_SQL,
        "op13_chat_format": chatformat.ORACLE_SQL,
    }
