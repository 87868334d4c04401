"""Contracts and settings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

RAW = ("entity_id", "business_name", "business_address", "country")
NORMALISED = (
    "entity_id", "country", "name_raw", "name_norm", "name_core", "legal_suffix", "name_tokens", "name_transliterated",
    "is_non_latin", "address_raw", "address_norm", "address_numbers", "address_pin",
)
PAIR = ("source1_entity_id", "candidate_entity_id", "candidate_source", "country")
LEG_FLAGS = {
    "name_tfidf_block_hit": 1, "char_ngram_block_hit": 2, "address_block_hit": 4, "exact_key_hit": 8, "pin_block_hit": 16,
    "phonetic_block_hit": 32, "embedding_block_hit": 64, "bidirectional_block_hit": 128,
}
CANDIDATE = (*PAIR, *LEG_FLAGS, "num_legs_retrieved", "blocking_score")
FEATURE_PREFIXES = ("name__", "addr__", "cross__", "sem__", "comp__", "block__")
SPLITS = ("train", "val")
RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in RAW])
NORMALISED_SCHEMA = T.StructType([T.StructField(c, T.BooleanType() if c == "is_non_latin" else T.StringType()) for c in NORMALISED])
TRUTH_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("source1_entity_id", "matched_entity_ids")])


@dataclass(frozen=True)
class BlockingConfig:
    """Caps and thresholds of candidate generation."""

    bucket_cap: int = 200
    bucket_rows: int = 30
    rows_per_leg: int = 30
    cross_kind_keys: bool = True
    word_max_df: float = 0.02
    char_max_df: float = 0.01
    max_df_rows: int = 10_000
    word_top: int = 40
    word_threshold: float = 0.15
    char_top: int = 40
    char_threshold: float = 0.30
    phonetic_top: int = 0
    phonetic_threshold: float = 0.5
    phonetic_weight: float = 0.0
    bidirectional_top: int = 3
    bidirectional_threshold: float = 0.30
    union_k: int = 80
    max_candidates: int = 30
    sibling_seed: float = 0.5
    sibling_cap: int = 100


@dataclass(frozen=True)
class DecisionConfig:
    """Selection of matches."""

    formula: str = "expected"
    min_prob: float = 0.0
    vetoes: bool = True
    exclusivity: bool = True
    tie_break: str = "smallest"
    prior_shift: float = 1.0
