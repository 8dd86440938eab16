"""Seeded corpora with known truth: events with many voices, confusable rivals, floods of copies, spam and noise.

Rows have vectors and entities, as no tagger or encoder is at hand; the same seed gives the same rows.
"""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "id long, user_id long, content string, embedding array<float>, entities array<string>, created_at timestamp, engagement_score int, ground_truth int, kind string"


def corpus(spark: SparkSession, topics: int = 4, posts: int = 12, noise: int = 10, dim: int = 32, seed: int = 911, start: datetime = datetime(2026, 3, 1)) -> DataFrame:
    """`topics` events of `posts` posts each within half an hour, every second one a rival of the one before.

    A rival's vectors lie near the other's and only its entities tell them apart. Kinds: `signal`; `flood`, three exact
    copies of a topic's first post; `near`, one reworded copy; `spam`, six posts of two authors on one theme; `weak`,
    three posts of three authors; `noise`, unrelated posts. `ground_truth` is the topic of signal, flood and near rows.
    """
    rng = np.random.default_rng(seed)
    rows: list[tuple] = []

    def unit(v: np.ndarray) -> np.ndarray:
        return v / np.linalg.norm(v)

    def add(kind: str, topic: int | None, user: int, text: str, v: np.ndarray, names: list[str]) -> None:
        n = len(rows)
        rows.append((n + 1, user, text, [float(x) for x in unit(v)], names, start + timedelta(seconds=7 * n), int(rng.integers(0, 50)), topic, kind))

    themes = [unit(rng.normal(size=dim)) for _ in range(topics)]
    for t in range(topics):
        centre = unit(themes[t - 1] + 0.55 * unit(rng.normal(size=dim))) if t % 2 else themes[t]
        themes[t] = centre
        for i in range(posts):
            v = centre + 0.35 * unit(rng.normal(size=dim))
            add("signal", t, 1000 * t + i, f"report {i} on happening {t}: figures {rng.integers(1000)} were revised again today", v, [f"ORG:actor{t}", "GPE:town"])
            if i == 0:
                first = (rows[-1][2], v)
        for i in range(3):
            add("flood", t, 1000 * t + 500 + i, first[0], first[1], [f"ORG:actor{t}"])
        add("near", t, 1000 * t + 600, first[0] + " (via desk)", first[1] + 0.03 * unit(rng.normal(size=dim)), [f"ORG:actor{t}"])
    for kind, n, voices in (("spam", 6, 2), ("weak", 3, 3)):
        centre = unit(rng.normal(size=dim))
        for i in range(n):
            add(kind, None, 90_000 + i % voices + (100 if kind == "weak" else 0), f"{kind} offer {i} is the best of all offers today", centre + 0.2 * unit(rng.normal(size=dim)), [f"ORG:{kind}"])
    for i in range(noise):
        add("noise", None, 99_000 + i, f"thought {i} about nothing that happened anywhere", rng.normal(size=dim), [])
    return spark.createDataFrame(rows, SCHEMA)
