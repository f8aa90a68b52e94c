"""The registered queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat import OP11_SQL, op11_chat_template
from .fingerprint import op2_lz_fingerprint
from .infill import OP12_SQL, op12_fill_in_middle
from .language import op10_language
from .mixing import op5_mixing
from .ngram_join import op3_ngram_join
from .packing import op4_packing
from .periods import op13_periodic_runs
from .quality import op1_quality
from .secrets import op7_secrets
from .topk import OP8_SQL, op8_topk
from .toxicity import op6_toxicity
from .urls import op9_url_rules


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": op1_quality,
        "op2_lz_fingerprint": op2_lz_fingerprint,
        "op3_ngram_join": op3_ngram_join,
        "op4_packing": op4_packing,
        "op5_mixing": op5_mixing,
        "op6_toxicity": op6_toxicity,
        "op7_secrets": op7_secrets,
        "op8_topk": op8_topk,
        "op9_url_rules": op9_url_rules,
        "op10_language": op10_language,
        "op11_chat_template": op11_chat_template,
        "op12_fill_in_middle": op12_fill_in_middle,
        "op13_periodic_runs": op13_periodic_runs,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_topk": OP8_SQL, "op11_chat_template": OP11_SQL, "op12_fill_in_middle": OP12_SQL}
