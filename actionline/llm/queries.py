"""The queries of this subpackage: one for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from actionline.llm.compression import op12_codes
from actionline.llm.lattice import op3_lattice
from actionline.llm.minhash import op8_minhash
from actionline.llm.mixing import OP5_SQL, op5_mixing
from actionline.llm.ogg import op10_ogg
from actionline.llm.packing import op6_packing
from actionline.llm.quality import op13_quality
from actionline.llm.resampling import OP11_SQL, op11_resampling
from actionline.llm.secrets import op7_secrets
from actionline.llm.tokens import op1_tokens
from actionline.llm.toxicity import op2_toxicity
from actionline.llm.warc import OP9_SQL, op9_warc
from actionline.llm.wrappers import op4_wrappers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_tokens": op1_tokens,
    "op2_toxicity": op2_toxicity,
    "op3_lattice": op3_lattice,
    "op4_wrappers": op4_wrappers,
    "op5_mixing": op5_mixing,
    "op6_packing": op6_packing,
    "op7_secrets": op7_secrets,
    "op8_minhash": op8_minhash,
    "op9_warc": op9_warc,
    "op10_ogg": op10_ogg,
    "op11_resampling": op11_resampling,
    "op12_codes": op12_codes,
    "op13_quality": op13_quality,
}

#: Twins in SQL, where SQL can express the result.
ORACLES: dict[str, str] = {"op5_mixing": OP5_SQL, "op9_warc": OP9_SQL, "op11_resampling": OP11_SQL}
