"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import codes, importance, topk
from .bpe import op1_byte_bpe
from .codes import op13_vector_codes
from .decontaminate import op2_benchmark_decontamination
from .importance import op11_importance_resampling
from .langid import op6_language_id
from .neardup import op10_minhash_near_dedup
from .pii import op4_pii
from .secrets import op5_secret_scan
from .suffixarray import op8_suffix_array_dedup
from .tokencount import op12_token_counts
from .topk import op3_exact_top_k
from .toxicity import op7_toxicity
from .windows import op9_substring_dedup


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (op1_byte_bpe, op2_benchmark_decontamination, op3_exact_top_k, op4_pii, op5_secret_scan, op6_language_id, op7_toxicity, op8_suffix_array_dedup, op9_substring_dedup, op10_minhash_near_dedup, op11_importance_resampling, op12_token_counts, op13_vector_codes, pipeline)
}
ORACLES = {"op3_exact_top_k": topk.ORACLE, "op11_importance_resampling": importance.ORACLE, "op13_vector_codes": codes.ORACLE}
