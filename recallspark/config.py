"""Settings of the engine and their defaults."""

from __future__ import annotations

from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    # decay
    base_lambda: float = 0.05
    transient_multiplier: float = 5.0
    reflection_decay_after: int = 750
    reflection_level_multiplier: float = 2.0
    # relevance
    alpha: float = 0.7
    boost: float = 15.0
    vector_threshold: float = 0.5
    vector_pass: int = 200
    scored_rows: int = 1000
    k1: float = 1.2
    b: float = 0.75
    phrase_boost: float = 10.0
    entity_boost: float = 5.0
    grounded_ratio: float = 0.6
    free_ratio: float = 0.4
    # query context
    entity_window: int = 10
    recency_step: float = 0.09
    top_entities: int = 5
    # selection
    bucket_share: float = 0.2
    top_importance_cap: int = 2
    scene_share: float = 0.6
    entity_share: float = 0.2
    world_share: float = 0.2
    # dedup
    dedup_cosine: float = 0.94
    dedup_jaccard: float = 0.6
    reflection_reject: float = 0.9
    reflection_replace: float = 0.8
    reflection_skip: float = 0.85
    contradiction_similarity: float = 0.6
    # graph
    entity_merge: float = 0.9
    token_overlap: float = 0.6
    node_segments: int = 3
    edge_segments: int = 5
    edge_tokens: int = 150
    edge_jaccard: float = 0.6
    hub_weight: float = 0.05
    community_stale: int = 100
    synthesis_chunk: int = 10
    # reflection
    reflect_at: int = 40
    reflections_kept: int = 50
    reflection_levels: int = 3
    # bookkeeping
    analysed_pairs: int = 5000
    page_size: int = 20


DEFAULTS = Settings()


def changed(settings: Settings) -> dict[str, tuple]:
    """Settings that differ from their defaults: name -> (value, default)."""
    return {f.name: (getattr(settings, f.name), getattr(DEFAULTS, f.name)) for f in fields(Settings) if getattr(settings, f.name) != getattr(DEFAULTS, f.name)}


def calls_per_minute(value, default: int = 10) -> int:
    """A call rate between 1 and 30; what isn't a number is the default."""
    try:
        return min(30, max(1, int(value)))
    except (TypeError, ValueError):
        return default
