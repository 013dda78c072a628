"""Configuration: JSON files into dicts, with the shipped defaults."""

from __future__ import annotations

import json
from pathlib import Path

# The defaults of the shipped configuration.
DEFAULTS = {
    "query": {"top_k": 20, "aggregation": "max", "score_threshold": 0.5, "degraded_cosine_threshold": 0.5},
    "eval": {"ndcg_k": 10, "threshold_grid": {"start": 0.05, "stop": 0.96, "step": 0.05}, "hard_informal_recall_floor": 0.80, "seed": 42},
    "deploy": {"speakers": ["adult", "child"], "min_confidence": 0.40, "top_k": 10, "dollar_cap": 15.0, "cost_per_call": 0.0001, "cosine_label_threshold": 0.4, "llm_label_threshold": 0.9},
    "splits": {"ratios": [0.8, 0.1, 0.1], "seed": 17, "informal_variant_families": 30},
    "confidence": {"weights": {"llm": 0.5, "cosine": 0.8, "structural": 0.8}, "auto_min": 0.70, "spot_min": 0.15, "structural_mode": "differs_only"},
    "audit": {"n_rows": 50, "seed": 42, "agreement_target": 0.80},
    "gates": {"auroc": 0.85, "spearman": 0.90, "slice_recall": 0.80, "audit": 0.80, "true_negative": 0.90},
}


def load_config(path: str | Path | None = None, part: str = "query") -> dict:
    """The part's defaults, overlaid with a JSON file; a missing file raises."""
    return DEFAULTS[part] | (json.loads(Path(path).read_text()) if path is not None else {})
