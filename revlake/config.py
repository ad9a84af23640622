"""Constants that define semantics, in one frozen value that operators take explicitly."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    # fixed values: chunking, in tokens
    chunk_target: int = 650
    chunk_max: int = 900
    chunk_min: int = 80
    chunk_overlap: int = 100
    parent_max: int = 1800
    # fixed values: retrieval
    top_k: int = 25
    rrf_k: int = 60
    final_k: int = 8
    token_budget: int = 6000
    max_distance: float = 0.95
    # fixed values: history
    history_turns: int = 6
    history_tokens: int = 1200
    # fixed values: runs
    run_limit: int = 200
    cost_threshold: int = 250
    ocr_min_chars: int = 180
    ocr_min_density: float = 0.0004
    embed_batch: int = 96
    embed_max_tokens: int = 8000
    # fixed values: leave rules, in days and months
    standard_days: int = 20
    senior_days: int = 31
    carry_over_days: int = 8
    carry_over_months: int = 4
    notice_short: int = 8
    notice_long: int = 31
    short_request: int = 5
    max_consecutive: int = 10
    probation_months: int = 3
    horizon_days: int = 400


DEFAULT = Config()
