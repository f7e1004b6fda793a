"""Queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from larkspan.llm import fingerprints, htmltext, mixing, neardup, packing, privacy, substrings, suffixtree, topk, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": mixing.op1_mixing,
        "op2_fingerprints": fingerprints.op2_fingerprints,
        "op3_topk": topk.op3_topk,
        "op4_htmltext": htmltext.op4_htmltext,
        "op5_private": privacy.op5_private,
        "op6_packing": packing.op6_packing,
        "op7_substrings": substrings.op7_substrings,
        "op8_suffixtree": suffixtree.op8_suffixtree,
        "op9_neardup": neardup.op9_neardup,
        "op10_toxicity": toxicity.op10_toxicity,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    out = {"op1_mixing": mixing.OP1_SQL, "op3_topk": topk.OP3_SQL, "op7_substrings": substrings.OP7_SQL, "op9_neardup": neardup.OP9_SQL}
    if corpus_pipeline.ORACLE_SQL:
        out["pipeline"] = corpus_pipeline.ORACLE_SQL
    return out
