"""Registered queries over the given tables."""

import importlib

MODULES = ["q_metrics", "q_labels", "q_sources", "q_convert", "q_tiles", "q_geometry", "q_photo", "q_volume",
           "q_predict", "q_losses", "q_sampling", "q_masks", "q_text", "q_logs", "q_streaming",
           "q_udfs"]


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"segspark.plans.{m}")


def all_queries() -> dict:
    from segspark.plans.registry import QUERIES
    _load()
    return QUERIES


def all_oracles() -> dict:
    from segspark.plans.registry import ORACLES
    _load()
    return ORACLES
