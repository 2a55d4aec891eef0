"""Queries over the training-data tables, and their SQL where SQL can express them."""

from __future__ import annotations

from importlib import import_module

from .ann import op4_ann
from .ball_kmeans import op12_ball_kmeans
from .decontam import op6_decontaminate
from .importance import op13_importance_resampling
from .langid import op3_language_id
from .mixing import op5_mix
from .near_dedup import op7_near_dedup
from .page_templates import op11_html_templates
from .pii import op9_pii
from .secrets import op10_secrets
from .sharding import op2_sharding
from .token_store import op8_token_store
from .urls import op1_url_filter


def queries() -> dict:
    ops = (
        op1_url_filter, op2_sharding, op3_language_id, op4_ann, op5_mix, op6_decontaminate, op7_near_dedup,
        op8_token_store, op9_pii, op10_secrets, op11_html_templates, op12_ball_kmeans, op13_importance_resampling,
    )
    # the pipeline is a module beside the library, found when it is run
    return {f.__name__: f for f in ops} | {"pipeline": lambda spark, sf_dir: import_module("corpus_pipeline").run(spark, sf_dir)}


def oracle_sql() -> dict[str, str]:
    return {}
