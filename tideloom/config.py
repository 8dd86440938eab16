"""Parameters of the clustering pipelines; every function takes what it needs as an argument with these defaults."""

from __future__ import annotations

from dataclasses import dataclass

# Thresholds, windows and limits of the public data model.


@dataclass(frozen=True)
class Config:
    similarity_margin: float = 0.05
    assign_threshold: float = 0.62
    candidate_threshold: float = 0.45
    centroid_update_threshold: float = 0.68
    similarity_floor: float = 0.45
    birth_min_authors: int = 4
    cohesion_floor: float = 0.45
    anchor_weight: float = 0.35
    centroid_max_members: int = 150
    hub_freshness_hours: float = 48.0
    merge_entity_floor: float = 0.45
    merge_no_identity_sim: float = 0.72
    merge_gap_hours: float = 12.0
    merge_identity_fraction: float = 0.5
    merge_identity_support: int = 2
    tiebreak_sim: float = 0.50
    near_duplicate_cosine: float = 0.98
    knn_k: int = 4
    half_life_hours: float = 12.0
    slice_hours: float = 1.0
    atom_overlap: float = 0.6
    atom_support: int = 2
    min_community: int = 4
    graph_similar_floor: float = 0.18
    preview_chars: int = 84


DEFAULT = Config()
