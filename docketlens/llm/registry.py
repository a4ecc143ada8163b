"""Queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontaminate import op1_decontamination
from .language import op5_language_id
from .quality import op8_quality_cascade
from .url_lists import OP4_SQL, op4_url_lists
from .toxicity import op6_toxicity
from .sharding import op2_sharding
from .chat import op3_chat_format
from .packing import op7_packing
from .pii import op9_pii
from .simhash import op10_simhash
from .merkle import OP11_SQL, op11_merkle
from .minhash import OP12_SQL, op12_minhash
from .ranked_search import OP13_SQL, op13_ranked_search


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": op1_decontamination,
        "op2_sharding": op2_sharding,
        "op3_chat_format": op3_chat_format,
        "op4_url_lists": op4_url_lists,
        "op5_language_id": op5_language_id,
        "op6_toxicity": op6_toxicity,
        "op7_packing": op7_packing,
        "op8_quality_cascade": op8_quality_cascade,
        "op9_pii": op9_pii,
        "op10_simhash": op10_simhash,
        "op11_merkle": op11_merkle,
        "op12_minhash": op12_minhash,
        "op13_ranked_search": op13_ranked_search,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_url_lists": OP4_SQL, "op11_merkle": OP11_SQL, "op12_minhash": OP12_SQL,
            "op13_ranked_search": OP13_SQL}
