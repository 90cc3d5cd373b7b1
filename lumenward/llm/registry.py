"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumenward.llm import mixing, warc
from lumenward.llm.decontaminate import op10_decontaminate
from lumenward.llm.fingerprint import op5_fingerprints
from lumenward.llm.katz import op1_katz
from lumenward.llm.pii import op7_pii
from lumenward.llm.sharding import op9_sharding
from lumenward.llm.simhash import op3_simhash
from lumenward.llm.tokens import op2_token_counts
from lumenward.llm.toxicity import op8_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_katz": op1_katz,
    "op2_token_counts": op2_token_counts,
    "op3_simhash": op3_simhash,
    "op4_mixing": mixing.op4_mixing,
    "op5_fingerprints": op5_fingerprints,
    "op6_warc": warc.op6_warc,
    "op7_pii": op7_pii,
    "op8_toxicity": op8_toxicity,
    "op9_sharding": op9_sharding,
    "op10_decontaminate": op10_decontaminate,
}

ORACLES: dict[str, str] = {
    "op4_mixing": mixing.ORACLE,
    "op6_warc": warc.ORACLE,
}
