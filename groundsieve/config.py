"""Settings of a retrieval run, as one plain immutable record."""

from __future__ import annotations

from dataclasses import dataclass, field
from types import MappingProxyType

# The stop words of the lexical tokeniser.
STOP_WORDS = (
    "a", "about", "an", "and", "are", "according", "anything", "associated", "be", "by",
    "can", "concept", "describe", "does", "given", "how", "is", "say", "should", "text",
    "that", "the", "their", "there", "these", "this", "to", "together", "what", "which",
    "with",
)

# The default query expansions.
DEFAULT_EXPANSIONS = MappingProxyType({
    "fasting": ("fast", "abstain", "abstinence", "ramadan"),
    "abstain": ("fast", "fasting", "ramadan"),
    "charity": ("alms", "giving", "poor", "zakat"),
    "mercy": ("merciful", "compassion", "forgiveness", "forgiver"),
    "prayer": ("pray", "prayers", "worship"),
    "patience": ("patient", "steadfast", "perseverance"),
    "parents": ("parent", "mother", "father"),
    "moses": ("musa", "pharaoh", "israel"),
    "eat": ("eating", "food", "lawful", "prohibited"),
    "restrictions": ("prohibited", "forbidden", "lawful", "food"),
})

# Okapi BM25 parameters and the floor factor for negative idf.
BM25_K1 = 1.5
BM25_B = 0.75
BM25_IDF_FLOOR = 0.25

# Fixed value: dimensions of the hashing embedder.
HASH_DIMS = 384

# Scores are rounded before they are ranked: sums over a shuffle have no fixed
# order, so equal passages would otherwise differ in the last bits and swap places.
SCORE_DIGITS = 6


@dataclass(frozen=True)
class RetrievalConfig:
    top_k_lexical: int = 30
    top_k_dense: int = 30
    reranker_top_k: int = 25
    top_k_anchors: int = 6
    hybrid_alpha: float = 0.5
    hybrid_beta: float = 0.5
    context_window_radius: int = 1
    max_bundle_passages: int = 12
    min_anchor_score: float | None = None
    reranker_enabled: bool = True
    overlap_boost_enabled: bool = False
    overlap_boost_value: float = 0.05
    lexical_query_expansion_enabled: bool = True
    lexical_query_expansions: dict = field(default_factory=lambda: dict(DEFAULT_EXPANSIONS))
    # True reproduces the known quirks listed in the README instead of fixing them.
    compat: bool = False
