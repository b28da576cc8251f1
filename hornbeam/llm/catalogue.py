"""The corpus operators' queries, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, htmlmain, linededup, lm, mpegts, packing, pii, simhash, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_linededup": linededup.query,
        "op2_toxicity": toxicity.query,
        "op3_mpegts": mpegts.query,
        "op4_packing": packing.query,
        "op5_decontamination": decontam.query,
        "op6_pii": pii.query,
        "op7_lm": lm.query,
        "op8_html": htmlmain.query,
        "op9_simhash": simhash.query,
        "op10_warc": warc.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_decontamination": decontam.ORACLE, "op10_warc": warc.ORACLE}
