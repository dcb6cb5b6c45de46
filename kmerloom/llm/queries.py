"""The queries of the pipeline operators, and SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from kmerloom.llm import op1_revisits, op5_urls, op9_mixing
from kmerloom.llm.op1_revisits import op1_revisit_resolution
from kmerloom.llm.op2_packing import op2_best_fit_packing
from kmerloom.llm.op3_simhash import op3_simhash_near_dedup
from kmerloom.llm.op4_toxicity import op4_toxicity
from kmerloom.llm.op5_urls import op5_url_language_ratio
from kmerloom.llm.op6_embeddings import op6_embedding_collisions
from kmerloom.llm.op7_reshard import op7_min_cost_resharding
from kmerloom.llm.op8_cnn import op8_quality_classifier
from kmerloom.llm.op9_mixing import op9_mixing_sources
from kmerloom.llm.op10_rules import op10_quality_rules

QUERIES = {
    f.__name__: f
    for f in (
        op1_revisit_resolution,
        op2_best_fit_packing,
        op3_simhash_near_dedup,
        op4_toxicity,
        op5_url_language_ratio,
        op6_embedding_collisions,
        op7_min_cost_resharding,
        op8_quality_classifier,
        op9_mixing_sources,
        op10_quality_rules,
    )
} | {"pipeline": corpus_pipeline.run}

ORACLES = {
    "op1_revisit_resolution": op1_revisits.ORACLE,
    "op5_url_language_ratio": op5_urls.ORACLE,
    "op9_mixing_sources": op9_mixing.ORACLE,
} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
