"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from descmap.llm import bpe, decontam, hosts, language, merkle, quality, simhash, substring, template, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language": language.op1_language,
        "op2_template": template.op2_template,
        "op3_quality": quality.op3_quality,
        "op4_hosts": hosts.op4_hosts,
        "op5_warc": warc.op5_warc,
        "op6_decontaminate": decontam.op6_decontaminate,
        "op7_simhash": simhash.op7_simhash,
        "op8_substring": substring.op8_substring,
        "op9_bpe": bpe.op9_bpe,
        "op10_merkle": merkle.op10_merkle,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_hosts": hosts.op4_sql(), "op5_warc": warc.op5_sql(), "op6_decontaminate": decontam.op6_sql(), "op8_substring": substring.op8_sql()}
