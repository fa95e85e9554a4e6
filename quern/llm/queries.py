"""Queries of this subpackage: name -> function of (spark, sf_dir), and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame

from quern.llm.dialogue import op11_conversation_repair
from quern.llm.hierbayes import op4_hierarchical_quality, page_site_quality
from quern.llm.linededup import op3_fuzzy_lines
from quern.llm.neardup import op6_hamming_neardup
from quern.llm.ordermin import op7_order_minhash
from quern.llm.packing import op9_best_fit_packing
from quern.llm.planes import op2_token_planes
from quern.llm.resample import op12_importance_resampling
from quern.llm.robust import ORACLE as QUALITY_SQL
from quern.llm.robust import op1_robust_quality
from quern.llm.secretscan import op10_secret_scan
from quern.llm.tileproduct import op13_embedding_neardup
from quern.llm.tokens import op5_token_counts, op8_bpe_codec
from quern.session import ship


def shipped(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The query, after this package has been sent to the executors."""

    @wraps(query)
    def run(spark, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


_ALL = {
    "op1_robust_quality": op1_robust_quality,
    "op2_token_planes": op2_token_planes,
    "op3_fuzzy_lines": op3_fuzzy_lines,
    "op4_hierarchical_quality": op4_hierarchical_quality,
    "op5_token_counts": op5_token_counts,
    "op6_hamming_neardup": op6_hamming_neardup,
    "op7_order_minhash": op7_order_minhash,
    "op8_bpe_codec": op8_bpe_codec,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_secret_scan": op10_secret_scan,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_embedding_neardup": op13_embedding_neardup,
    "page_site_quality": page_site_quality,
}
QUERIES = {name: shipped(query) for name, query in _ALL.items()}

ORACLE: dict[str, str] = {"op1_robust_quality": QUALITY_SQL}
