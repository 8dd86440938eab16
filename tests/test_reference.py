"""Published expectations of the reference's operators, on planted rows."""

from __future__ import annotations

import hashlib
import re
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideloom.functions import text as tx
from tideloom.functions import vectors as vx
from tideloom.operators import birth, folding, ledger, matching, merging, policy, quality
from tideloom.plans import control_queries, reference_queries

T0 = datetime(2026, 3, 1, 10)


def one(spark, column, **values):
    kinds = {k: v[1] for k, v in values.items()}
    df = spark.createDataFrame([tuple(v[0] for v in values.values())], ", ".join(f"{k} {t}" for k, t in kinds.items()))
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(("sim", "runner", "status"), [(0.93, 0.87, "assigned"), (0.90, None, "assigned"), (0.90, 0.88, "candidate"), (0.50, None, "candidate"), (0.40, None, "unassigned"), (None, None, "unassigned")])
def test_decision(spark, sim, runner, status):
    assert one(spark, matching.decision(F.col("s"), F.col("r"), 0.88), s=(sim, "double"), r=(runner, "double")) == status


@pytest.mark.parametrize(("sim", "runner", "status", "why"), [(0.92, 0.90, "assigned", "confident_assign"), (0.90, 0.88, "candidate", "margin_fail"), (0.80, None, "candidate", "below_threshold"), (0.40, None, "unassigned", "below_candidate_floor")])
def test_reason(spark, sim, runner, status, why):
    assert one(spark, matching.reason(F.col("s"), F.col("r"), F.col("t"), 0.88), s=(sim, "double"), r=(runner, "double"), t=(status, "string")) == why


def test_signature(spark):
    def plain(s):
        n = " ".join(re.sub(r"https?://\S+|www\.\S+", "", (s or "").lower()).split())
        return (int.from_bytes(hashlib.sha256(n.encode()).digest()[:8], "big") & ((1 << 63) - 1)) or 1

    texts = ["A b", "a   B", "a b https://x.org/y", "a, b", "", None, "x　y\x1cz", "ß Straße"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select(tx.content_signature(F.col("t")).alias("s")).collect()
    assert [r.s for r in got] == [plain(t) for t in texts]


def test_text_functions(spark):
    rows = {"": "empty_text", "   ": "empty_text", "too few words": "too_short", "lol that was such a great show today folks": "chatter_marker", "i think my dog and me like myself my home": "personal_diary", "The council should vote on the budget next week": None}
    got = spark.createDataFrame([(t,) for t in rows], "t string").select("t", tx.gate_precheck(F.col("t")).alias("r")).collect()
    assert {r.t: r.r for r in got} == rows
    assert one(spark, tx.cleanse(F.col("t")), t=("Breaking: @bob  Check this out! https://x.org", "string")) == "Breaking Check this out"
    assert one(spark, tx.preview(F.col("t")), t=("x" * 90, "string")) == "x" * 83 + "…"
    assert one(spark, tx.preview(F.col("t")), t=("", "string")) is None
    assert one(spark, tx.slug(F.col("t"), F.lit("hub-1")), t=("--- !", "string")) == "hub-1"
    tokens = one(spark, tx.identity_tokens(F.col("e")), e=(["ORG: Apple ", "ORG:apple", "GPE:Oslo", "PERSON:the fans", "ORG:42", None, "x"], "array<string>"))
    assert tokens == ["ORG:apple"]
    assert one(spark, tx.identity_tokens(F.col("e")), e=(None, "array<string>")) == []


def test_vector_functions(spark):
    a, b = [1.0, 0.0], [0.0, 1.0]
    kind = "array<float>"
    blended = one(spark, vx.blend("a", "b"), a=(a, kind), b=(b, kind))
    n = (0.35**2 + 0.65**2) ** 0.5
    assert blended == pytest.approx([0.35 / n, 0.65 / n])
    rolled = one(spark, vx.rolling("a", "c", "b", "k"), a=(a, kind), c=(200, "int"), b=(b, kind), k=(1, "int"))
    assert rolled == pytest.approx([150 / 151, 1 / 151])
    assert one(spark, vx.rolling("a", "c", "b", "k"), a=(None, kind), c=(None, "int"), b=([2.0, 4.0], kind), k=(2, "int")) == pytest.approx([1, 2])
    assert one(spark, vx.cosine("a", "b"), a=(a, kind), b=([0.0, 0.0], kind)) is None
    assert one(spark, vx.from_text(vx.to_text("a")), a=([0.5, -0.25], kind)) == [0.5, -0.25]
    assert one(spark, vx.from_text(vx.to_text("a")), a=(None, kind)) == []


def test_match_top2_ties_and_missing(spark):
    posts = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0]), (5, [0.6, 0.8])], "id long, embedding array<float>")
    hubs = spark.createDataFrame([(9, [0.0, 1.0]), (7, [0.0, 2.0]), (3, [1.0, 0.0]), (4, None)], "id long, centroid array<float>")
    got = {r.post_id: (r.event_id, r.runner_id) for r in matching.match_top2(posts, hubs, 2).collect()}
    assert got == {1: (3, 7), 2: (None, None), 3: (None, None), 4: (None, None), 5: (7, 9)}
    empty = matching.match_top2(posts, hubs.where("id < 0"), 2).collect()
    assert len(empty) == 5 and all(r.sim is None for r in empty)


def worker_peak(spark) -> int:
    """The most memory, in KB, that a Python worker of the session has held."""

    def peak(stream):
        import resource
        import time

        import pyarrow as pa

        for _ in stream:
            time.sleep(0.3)  # so that every worker is asked
            yield pa.RecordBatch.from_arrays([pa.array([resource.getrusage(resource.RUSAGE_SELF).ru_maxrss])], names=["kb"])

    return spark.range(0, 8, 1, 8).mapInArrow(peak, "kb long").agg(F.max("kb")).first()[0]


def test_match_top2_holds_a_slice_of_the_cosines(spark):
    n = 20_000  # one batch of 10,000 posts against one block: all cosines at once are 1.6 GB
    posts = spark.range(10_000).select("id", F.array(F.cos("id"), F.sin("id"), F.lit(0.5)).cast("array<float>").alias("embedding")).coalesce(1)
    hubs = spark.range(n).select("id", F.array(F.cos(F.col("id") / n), F.sin(F.col("id") / n), F.col("id") / n).cast("array<float>").alias("centroid"))
    assert matching.match_top2(posts, hubs, 3).where("event_id is not null and runner_id is not null").count() == 10_000

    most = worker_peak(spark)
    assert most < 1_000_000, f"a worker held {most >> 10} MB"


@pytest.mark.parametrize("name", ["assign_with_identity", "decide_assignment"])
def test_assignment_queries_hold_a_slice_of_the_cosines(spark, tmp_path, name):
    vector = F.transform(F.sequence(F.lit(1), F.lit(384)), lambda i: F.cos(i * (F.col("id") % 50 + 1)).cast("float"))
    at = F.lit(T0).alias("received_at")
    spark.range(10_000).select("id", at, vector.alias("embedding"), F.array(F.lit("ORG:a")).alias("entities"), F.lit(1).cast("long").alias("event_id"), F.lit(None).cast("timestamp").alias("deleted_at")).coalesce(1).write.parquet(f"{tmp_path}/posts.parquet")
    spark.range(20_000).select("id", F.lit(T0).alias("last_updated_at"), F.lit(True).alias("is_active"), vector.alias("centroid")).write.parquet(f"{tmp_path}/event_hubs.parquet")
    queries = reference_queries.QUERIES | control_queries.QUERIES
    rows = queries[name](spark, str(tmp_path)).groupBy("status").count().collect()  # a bare count would not match at all
    assert sum(r["count"] for r in rows) == 10_000
    most = worker_peak(spark)
    assert most < 1_000_000, f"a worker held {most >> 10} MB"


def test_decide_assignment_sends_hubs_in_single_precision(spark, tmp_path, monkeypatch):
    vector = F.transform(F.sequence(F.lit(1), F.lit(384)), lambda i: F.cos(i * (F.col("id") % 50 + 1)).cast("float"))
    spark.range(100).select("id", F.lit(T0).alias("received_at"), vector.alias("embedding")).write.parquet(f"{tmp_path}/posts.parquet")
    spark.range(3_000).select("id", F.lit(T0).alias("last_updated_at"), F.lit(True).alias("is_active"), vector.alias("centroid")).write.parquet(f"{tmp_path}/event_hubs.parquet")
    sent, send = [], spark.sparkContext.broadcast
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda value: sent.append(sum(a.nbytes for a in value)) or send(value))
    assert reference_queries.decide_assignment(spark, str(tmp_path)).where("status is not null").count() == 100
    assert sum(sent) < 1.05 * 3_000 * 384 * 4, f"{sum(sent)} bytes"


def test_best_two_makes_no_copy_of_the_hubs():
    import tracemalloc

    rng = np.random.default_rng(7)
    x = rng.normal(size=(256, 384))
    hubs = np.concatenate([rng.normal(size=(7_900, 384)), np.repeat(x[:1], 100, axis=0)]).astype(np.float32)  # one post with many ties
    wide, length = matching.scaled(hubs.astype(np.float64))
    wide = wide.astype(np.float32)
    tracemalloc.start()
    try:
        matching.best_two(x / np.linalg.norm(x, axis=1, keepdims=True), wide, wide, length)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 8_000_000, f"{most >> 20} MB; the hubs are 12 MB in single precision, 24 in double"


@pytest.mark.parametrize("kind", ["float", "double"])
def test_match_top2_of_long_and_short_vectors(spark, kind):
    rng = np.random.default_rng(9)
    c = rng.normal(size=(300, 6)) * 10.0 ** rng.integers(-36, 36, (300, 1))
    c[200:] = c[:100] * 2.0 ** rng.integers(-3, 4, (100, 1))  # of equal direction: the smaller id is first
    c = c.astype(np.float32 if kind == "float" else np.float64).astype(float)
    x = rng.normal(size=(90, 6)).astype(np.float32).astype(float)
    x[:40] = c[:40] / np.linalg.norm(c[:40], axis=1, keepdims=True)
    posts = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    hubs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], f"id long, centroid array<{kind}>")
    unit = lambda a: a / np.linalg.norm(a, axis=1, keepdims=True)
    s = np.round(np.einsum("ij,kj->ik", unit(x), unit(c)), 12)
    got = {r.post_id: (r.event_id, r.runner_id, round(r.sim, 9), round(r.runner_sim, 9)) for r in matching.match_top2(posts, hubs, 6).collect()}
    best = np.array([np.lexsort((np.arange(300), -row))[:2] for row in s])
    assert got == {i: (int(b), int(r), round(s[i, b], 9), round(s[i, r], 9)) for i, (b, r) in enumerate(best)}


def test_best_two_decides_in_double():
    rng = np.random.default_rng(3)
    unit = lambda a: a / np.linalg.norm(a, axis=1, keepdims=True)
    x, base = unit(rng.normal(size=(40, 384))), rng.normal(size=(500, 384))
    near = x[0] + rng.normal(size=(100, 384)) * 1e-5  # more near ties than are taken singly
    few = x[1] + rng.normal(size=(10, 384)) * 1e-5
    for hubs in (np.concatenate([base, near, few, base[:5], few]), base[:1], base[:2], np.repeat(base[:1], 50, axis=0)):
        wide = unit(hubs)
        got: dict[int, list] = {}
        for row, place, sim in matching.best_two(x, wide, wide.astype(np.float32)):
            for r, p, s in zip(row.tolist(), place.tolist(), sim.tolist()):
                got.setdefault(r, []).append((p, s))
        s = np.round(x @ wide.T, 12)
        want = {r: [(int(p), s[r, p]) for p in np.lexsort((np.arange(len(wide)), -s[r]))[:2]] for r in range(len(x))}
        assert {r: [p for p, _ in v] for r, v in got.items()} == {r: [p for p, _ in v] for r, v in want.items()}
        assert all(abs(a[1] - b[1]) < 1e-11 for r in want for a, b in zip(got[r], want[r]))


def test_best_two_holds_the_cosines_of_a_tile():
    import tracemalloc

    rng = np.random.default_rng(5)
    unit = lambda a: a / np.linalg.norm(a, axis=1, keepdims=True)
    x, wide = unit(rng.normal(size=(256, 32))), unit(rng.normal(size=(20_000, 32)))
    narrow = wide.astype(np.float32)
    tracemalloc.start()
    try:
        matching.best_two(x, wide, narrow)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 10_000_000, f"{most >> 20} MB; the cosines of the whole block are 20 MB"


@pytest.mark.parametrize("n", [1, 2, matching.HUB_TILE - 1, matching.HUB_TILE, matching.HUB_TILE + 1, 2 * matching.HUB_TILE + 3])
def test_best_two_across_tiles(n):
    rng = np.random.default_rng(n)
    unit = lambda a: a / np.linalg.norm(a, axis=1, keepdims=True)
    x, wide = unit(rng.integers(1, 4, (50, 6)).astype(float)), unit(rng.integers(1, 4, (n, 6)).astype(float))  # many exact ties
    got: dict[int, list] = {}
    for row, place, _ in matching.best_two(x, wide, wide.astype(np.float32)):
        for r, p in zip(row.tolist(), place.tolist()):
            got.setdefault(r, []).append(p)
    s = np.round(np.einsum("ij,kj->ik", x, wide), 12)
    assert got == {r: np.lexsort((np.arange(n), -s[r]))[:2].tolist() for r in range(len(x))}


def test_tiebreak_and_veto(spark):
    m = spark.createDataFrame([(1, 10, 0.60, 11, 0.58), (2, 10, 0.90, 11, 0.1), (3, 10, 0.60, 11, 0.58)], "post_id long, event_id long, sim double, runner_id long, runner_sim double")
    e = spark.createDataFrame([(1, ["ORG:b"]), (2, ["ORG:b"]), (3, None)], "post_id long, entities array<string>")
    i = spark.createDataFrame([(10, ["ORG:a"]), (11, ["ORG:b"])], "event_id long, tokens array<string>")
    got = {r.post_id: (r.status, r.event_id, r.reason) for r in matching.assign(m, e, i).collect()}
    assert got == {1: ("assigned", 11, "entity_tiebreak"), 2: ("candidate", None, "entity_conflict"), 3: ("candidate", None, "below_threshold")}


POST = "id long, event_id long, content_sig long, repost_of_id long, deleted_at timestamp"


def test_exact_fold(spark):
    rows = [(1, 5, 77, None, None), (2, 5, 77, None, None), (3, 5, 77, 1, None), (4, 6, 77, None, None), (5, 5, 0, None, None), (6, 5, 0, None, None), (7, 5, 88, 2, None), (8, 5, 88, None, None), (9, 5, 77, None, T0)]
    got = {(r.id, r.keep_id) for r in folding.exact_fold(spark.createDataFrame(rows, POST)).collect()}
    assert got == {(2, 1), (8, 2)}
    counts = {r.event_id: (r.member_count, r.repost_count) for r in folding.hub_counts(spark.createDataFrame(rows, POST)).collect()}
    assert counts == {5: (5, 2), 6: (1, 0)}


def test_near_duplicates(spark):
    v = lambda a: [float(np.cos(a)), float(np.sin(a))]
    rows = [(12, 1, v(0.0)), (11, 1, v(0.01)), (9, 2, v(1.0)), (5, 2, v(1.0)), (20, 1, v(0.8)), (101, 3, v(0.0)), (100, 3, v(0.15)), (102, 3, v(0.3)), (30, 3, None), (31, 3, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, event_id long, embedding array<float>")
    for block in (4096, 2):
        links = folding.near_duplicate_links(df, 2, block=block)
        assert {(r.id, r.keep_id) for r in folding.near_duplicate_fold(links).collect()} == {(12, 11), (9, 5), (101, 100), (102, 100)}


def test_flatten_reposts(spark):
    rows = [(2, 1), (3, 2), (4, 3), (5, 4), (8, 9), (9, 8), (1, None)]
    got = {r.id: r.repost_of_id for r in folding.flatten_reposts(spark.createDataFrame(rows, "id long, repost_of_id long")).collect()}
    assert {k: got[k] for k in (2, 3, 4, 5)} == {2: 1, 3: 1, 4: 1, 5: 1}


def test_slices(spark):
    at = [T0, T0 + timedelta(minutes=30), T0 + timedelta(hours=2)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(at)], "id long, created_at timestamp")
    assert [r.slice_id for r in birth.temporal_slices(df).orderBy("id").collect()] == [0, 0, 1]
    near = spark.createDataFrame([(i, T0 + timedelta(minutes=25 * i)) for i in range(9)], "id long, created_at timestamp")
    assert [r.slice_id for r in birth.temporal_slices(near).orderBy("id").collect()] == [0, 0, 0, 1, 1, 1, 2, 2, 2]


def test_knn_and_communities(spark):
    rows = [(1, 0, [1.0, 0.0], T0), (2, 0, [1.0, 0.0], T0 + timedelta(minutes=30)), (3, 0, [0.0, 1.0], T0)]
    got = birth.knn_graph(spark.createDataFrame(rows, "id long, slice_id long, embedding array<float>, created_at timestamp")).collect()
    assert [(r.src, r.dst) for r in got] == [(1, 2)] and 0.95 <= got[0].weight <= 1
    rnd = np.random.default_rng(1)
    many = spark.createDataFrame([(i, i % 2, [float(z) for z in rnd.normal(size=3)], T0 + timedelta(minutes=i)) for i in range(60)], "id long, slice_id long, embedding array<float>, created_at timestamp")
    whole, parts = ({(r.src, r.dst, round(r.weight, 9)) for r in birth.knn_graph(many, block=b).collect()} for b in (4096, 7))
    assert whole == parts and len(whole) > 50
    clique = lambda a: [(i, j, 1.0) for i in a for j in a if i < j]
    found = birth.louvain([99], clique([1, 2, 3, 4]) + clique([5, 6, 7, 8]) + [(4, 5, 0.1)])
    assert found == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5, 7: 5, 8: 5, 99: 99}


def threads_of(spark, posts, part=0):
    rows = [(part, 1, i, sorted(t), v) for i, (t, v) in posts.items()]
    df = spark.createDataFrame(rows, "slice_id long, community long, id long, tokens array<string>, v array<double>")
    got = {}
    for r in birth.split_communities(df, 2).collect():
        got.setdefault(r.thread, set()).add(r.id)
    return got


def test_entity_split(spark):
    x, y = [1.0, 0.0], [0.0, 1.0]
    posts = {i: ({"ORG:apple"}, x) if i < 5 else ({"ORG:samsung"}, y) for i in range(1, 10)}
    posts[4] = ({"ORG:apple", "ORG:samsung"}, x)  # names both, stands near the first
    posts[9] = (set(), y)  # names none
    assert threads_of(spark, posts) == {1: {1, 2, 3, 4}, 5: {5, 6, 7, 8, 9}}
    posts[4] = ({"ORG:apple", "ORG:samsung"}, None)  # without a vector: to the actor with more posts
    assert threads_of(spark, posts) == {1: {1, 2, 3}, 4: {4, 5, 6, 7, 8, 9}}
    assert threads_of(spark, {1: (set(), x), 2: (set(), None)}) == {1: {1, 2}}
    alias = {i: ({"ORG:apple", "PRODUCT:phone"} if i < 5 else {"ORG:apple"}, x) for i in range(1, 7)}
    assert threads_of(spark, alias) == {1: {1, 2, 3, 4, 5, 6}}  # stand together in all posts of the rarer
    lone = {1: ({"a"}, x), 2: ({"a"}, x), 3: ({"b"}, y), 4: ({"c"}, y)}
    assert threads_of(spark, lone) == {1: {1, 2, 3, 4}}  # single posts join the largest


def test_birth_guards_and_chain(spark):
    rnd = np.random.default_rng(3)

    def cloud(first, n, centre, hour, author, tokens):
        return [(first + i, [float(z) for z in np.array(centre) + 0.02 * rnd.normal(size=3)], T0 + timedelta(hours=hour, minutes=i), tokens, author(i), i) for i in range(n)]

    rows = cloud(1, 6, [1, 0, 0], 0, lambda i: f"a{i}", ["ORG:x"]) + cloud(10, 6, [0, 1, 0], 0, lambda i: f"a{i % 2}", ["ORG:y"]) + cloud(20, 3, [0, 0, 1], 0, lambda i: f"a{i}", ["ORG:z"]) + cloud(30, 3, [1, 0, 0], 5, lambda i: f"b{i}", ["ORG:x"])
    df = spark.createDataFrame(rows, "id long, embedding array<double>, created_at timestamp, entities array<string>, author string, engagement_score int")
    hubs = spark.createDataFrame([(50, [0.0, -1.0, 0.0], 3, None)], "id long, centroid array<float>, member_count int, seed_post_id long")
    found, state = birth.birth(df, hubs, 3)
    got = {r.id: (r.event_id, r.role) for r in found.collect()}
    # Six posts of six authors are born; two authors and three posts are not; the later three join the hub that was born.
    assert set(got) == {1, 2, 3, 4, 5, 6, 30, 31, 32} and {e for e, _ in got.values()} == {51} and got[6] == (51, "seed") and got[30] == (51, "member")
    new = {r.id: r for r in state.collect()}
    assert set(new) == {50, 51} and new[51].member_count == 9 and new[51].seed_post_id == 6 and np.linalg.norm(new[51].centroid) == pytest.approx(1, abs=1e-5)


def test_cohesion_and_fallback(spark):
    eye = [(1, i, [float(i == j) for j in range(4)]) for i in range(4)]
    got = birth.cohesion(spark.createDataFrame(eye, "g long, id long, v array<float>"), "g", "v", 4).first()
    assert got.cohesion == pytest.approx(0.25)
    posts = pd.DataFrame({"id": [1, 2, 3], "embedding": [[1.0, 0.1], [0.0, 1.0], [0.9, 0.3]]})
    moved, centres, counts = birth.ordered_fallback(posts, [7, 3], np.array([[1.0, 0.0], [1.0, 0.0]]), [1, 0])
    assert moved[["id", "event_id"]].values.tolist() == [[1, 7], [3, 7]] and centres[0][1] > 0 and counts == [3, 1]
    assert np.linalg.norm(centres, axis=1) == pytest.approx([1, 1])
    assert birth.ordered_fallback(posts, [], np.zeros((0, 2)), [])[0].empty


def test_threshold_and_versions_of_policies(spark):
    config = spark.createDataFrame([("global_similarity_threshold", 0.62)], "key string, value double")
    history = spark.createDataFrame([], "id long, policy_version string, knob string, old_value double, new_value double, status string, source string, rationale string, actor string, created_at timestamp")
    knob = "global_similarity_threshold"
    for bad in (0.49, 1.0):
        with pytest.raises(ValueError):
            policy.checked(knob, bad)
    with pytest.raises(ValueError):
        policy.checked("other", 0.7)
    assert policy.checked(knob, 0.9) == 0.9 and policy.checked(knob, 0.5) == 0.5
    one, log = policy.apply_change(config, history, knob, 0.7, "panel", "me", T0)
    with pytest.raises(ValueError, match="already"):
        policy.apply_change(one, log, knob, 0.7, "panel", "me", T0)
    log = policy.propose_change(one, log, knob, 0.75, "autotune", None, T0)
    two, log = policy.revert_change(one, log, 1, "me", T0)
    assert two.first().value == 0.62
    assert [(r.id, r.policy_version, r.old_value, r.new_value, r.status) for r in log.orderBy("id").collect()] == [(1, "policy-v1", 0.62, 0.7, "applied"), (2, "pending", None, 0.75, "proposed"), (3, "policy-v2", 0.7, 0.62, "applied")]
    models = spark.createDataFrame([(1, "m1", "p", 0.96, 0.85, 0.01, "promoted", T0)], "id long, model_version string, adapter_path string, precision double, recall double, noise double, status string, promoted_at timestamp")
    assert policy.promotion_verdict(models, 0.94, 0.9, 0.0) == "rejected: gates" and policy.promotion_verdict(models, 0.95, 0.81, 0.01) == "rejected: worse"
    assert policy.promotion_verdict(models, 0.96, 0.9, 0.02) == "rejected: noise" and policy.promotion_verdict(models, 0.97, 0.9, 0.02) == "promoted"
    after = policy.promote(models, "m2", "q", 0.97, 0.9, 0.01, T0 + timedelta(days=1))
    assert {r.model_version: r.status for r in after.collect()} == {"m1": "retired", "m2": "promoted"}
    assert tuple(policy.current_versions(log, after).first()) == ("policy-v3", "m2")
    got = spark.createDataFrame([(0.80,), (0.91,), (None,), (0.99,)], "t double").select(policy.effective_threshold(F.col("t"), 0.88).alias("e")).collect()
    assert [r.e for r in got] == [0.88, 0.91, 0.88, 0.99]


def test_redirects(spark):
    hubs = spark.createDataFrame([(1, False, None), (2, False, 1), (3, True, None), (4, False, 5), (5, False, 3), (6, False, 999)], "id long, is_active boolean, merged_into_id long")
    got = {r.id: (r.canonical_id, r.redirected) for r in merging.canonical_hub(hubs).collect()}
    assert got == {1: (1, False), 2: (1, True), 3: (3, False), 4: (3, True), 5: (3, True), 6: (999, True)}


def test_merge_candidates_judge_and_greedy(spark):
    hubs = spark.createDataFrame([(1, True, 5, T0, [1.0, 0.0]), (2, True, 5, T0 + timedelta(hours=11), [0.9, 0.1]), (3, True, 9, T0 + timedelta(hours=18), [0.95, 0.0]), (4, False, 9, T0, [1.0, 0.0])], "id long, is_active boolean, member_count int, last_updated_at timestamp, centroid array<float>")
    pairs = merging.merge_candidates(hubs, 2)
    assert {(r.a, r.b) for r in pairs.collect()} == {(1, 2), (3, 2)}
    assert {(r.source_id, r.target_id) for r in merging.greedy_merges(pairs, hubs).collect()} == {(2, 3)}
    three = spark.createDataFrame([(i, 5) for i in (1, 2, 3)], "id long, member_count int")
    chain = merging.greedy_merges(spark.createDataFrame([(1, 2), (1, 3), (2, 3)], "a long, b long"), three)
    assert [(r.source_id, r.target_id) for r in chain.orderBy("step").collect()] == [(1, 2), (2, 3)]  # equals: the later survives, and 1 goes on as 2
    equal = spark.createDataFrame([(1, 2)], "a long, b long")
    assert {(r.source_id, r.target_id) for r in merging.greedy_merges(equal, hubs).collect()} == {(1, 2)}
    arr = "array<string>"
    verdict = lambda s, oa, ia, ob, ib: one(spark, merging.judge(F.col("s"), F.col("oa"), F.col("ia"), F.col("ob"), F.col("ib")), s=(s, "double"), oa=(oa, arr), ia=(ia, arr), ob=(ob, arr), ib=(ib, arr))
    assert verdict(0.99, ["ORG:a"], ["ORG:a"], ["ORG:b"], ["ORG:b"]) == "dominant_org_conflict"
    assert verdict(0.5, [], ["NORP:x"], [], ["NORP:x"]) == "shared_identity"
    assert verdict(0.9, [], ["NORP:x"], [], ["NORP:y"]) == "identity_divergent"
    assert verdict(0.72, [], [], [], ["NORP:y"]) == "high_similarity"


def test_merges_to_a_fixpoint(spark):
    hubs = spark.createDataFrame([(i, True, "active", None, n, 0, [float(x) for x in v], T0) for i, n, v in ((1, 9, [1, 0.1]), (2, 4, [1, 0.2]), (3, 2, [0.9, 0.3]), (4, 5, [0, 1]))], "id long, is_active boolean, status string, merged_into_id long, member_count int, repost_count int, centroid array<float>, last_updated_at timestamp")
    posts = spark.createDataFrame([(i, i, "assigned", None, None, ["x"]) for i in (1, 2, 3, 4)], "id long, event_id long, assignment_status string, deleted_at timestamp, repost_of_id long, entities array<string>")
    p, h, done = merging.merge_to_fixpoint(posts, hubs, 2, T0)
    assert {(r.source_id, r.target_id) for r in done.collect()} == {(2, 1), (3, 1)}
    assert {r.id: r.event_id for r in p.collect()} == {1: 1, 2: 1, 3: 1, 4: 4} and {r.id for r in h.where("is_active").collect()} == {1, 4}


def test_codenames(spark):
    rows = [(1, T0, "federal-reserve-cuts", None), (2, T0 + timedelta(1), "fed-reserve", None), (3, T0, None, "the_and"), (4, T0, "", ""), (5, T0, "a-harbour-2024-fire", None)]
    got = {r.id: r.codename for r in merging.codenames(spark.createDataFrame(rows, "id long, created_at timestamp, handle string, title string")).collect()}
    assert got == {1: "FED-RESERVE", 2: "FED-RESERVE-2", 3: "THE-AND", 4: "HUB4", 5: "HARBOU"}


def test_handles_are_distinct(spark):
    rows = [(1, "a"), (2, "a"), (3, "a-2"), (4, "a"), (5, "a-2"), (6, "a-4"), (7, "a")]
    got = {r.id: r.handle for r in ledger.numbered_names(spark.createDataFrame(rows, "id long, base string"), "id", "base").collect()}
    assert got == {1: "a", 2: "a-3", 3: "a-2", 4: "a-5", 5: "a-2-2", 6: "a-4", 7: "a-6"} and len(set(got.values())) == 7


def test_similar_hubs_without_a_time_window(spark):
    hubs = spark.createDataFrame([(1, True, 5, T0, [1.0, 0.0]), (2, True, 5, T0 + timedelta(days=90), [0.9, 0.1]), (3, True, 1, None, [0.95, 0.0]), (4, False, 9, T0, [1.0, 0.0]), (5, True, 1, T0, [0.0, 1.0])], "id long, is_active boolean, member_count int, last_updated_at timestamp, centroid array<float>")
    assert {(r.a, r.b) for r in merging.merge_candidates(hubs, 2, floor=0.18, gap_hours=None).collect()} == {(1, 2), (1, 3), (2, 3)}


def test_threshold_curve_and_pick(spark):
    rows = [(0.95, "good"), (0.91, "good"), (0.88, "good"), (0.90, "bad"), (0.84, "bad")]
    curve = quality.threshold_curve(spark.createDataFrame(rows, "similarity double, label string"))
    got = {r.threshold: r for r in curve.collect()}
    assert got[0.88].precision == pytest.approx(0.75) and got[0.90].precision == pytest.approx(2 / 3) and got[0.91].precision == 1.0
    assert [got[t].coverage for t in sorted(got)] == sorted((r.coverage for r in got.values()), reverse=True)
    assert quality.pick_threshold(curve, 0.88, 0.97, 0.6).first().threshold == 0.91
    assert quality.pick_threshold(curve, 0.99).count() == 0
    split = quality.threshold_curve(spark.createDataFrame([(0.91004, "good"), (0.90996, "good"), (0.91, "bad")], "similarity double, label string")).collect()
    assert [(r.threshold, r.tp, r.fp) for r in split] == [(0.91, 1, 1)]


def test_rollups_and_drift(spark):
    log = spark.createDataFrame([(1, 1, "user_confirmed", "p1", "m1", T0), (2, 2, "user_confirmed", "p1", "m1", T0), (3, 3, "user_removed", "p1", "m1", T0), (4, 3, "user_merged_source", None, None, T0)], "id long, post_id long, feedback_type string, policy_version string, model_version string, created_at timestamp")
    got = {r.policy_version: r for r in quality.human_rollup(log).collect()}
    assert got["p1"].precision == pytest.approx(2 / 3) and got["p1"].unlink_rate == pytest.approx(1 / 3) and got["unknown"].precision is None
    dec = spark.createDataFrame([(1, "assigned", 0.99), (2, "assigned", 0.99), (3, "assigned", 0.80)], "post_id long, status string, similarity double")
    assert quality.drift(log, dec).where("policy_version = 'p1'").first().drift == pytest.approx(0.19)


def test_clustering_scores(spark):
    same = spark.createDataFrame([(i, i // 3, 10 + i // 3) for i in range(9)], "id long, t long, f long")
    s = quality.clustering_scores(same, "t", "f").first()
    assert (s.precision, s.recall, s.f1, s.purity) == (1, 1, 1, 1) and s.nmi == pytest.approx(1) and s.ari == pytest.approx(1)


def test_upsert(spark):
    stored = spark.createDataFrame([("a", 1, T0, None), ("b", 2, None, T0), ("c", 3, None, None)], "k string, v int, published_at timestamp, deleted_at timestamp")
    new = spark.createDataFrame([("a", 5, None, 1), ("a", 6, None, 2), ("b", 9, None, 1), ("d", 7, None, 1)], "k string, v int, published_at timestamp, n int")
    got = {r.k: (r.v, r.published_at) for r in ledger.upsert(stored, new, ["k"], [F.desc("n")], ["published_at"]).collect()}
    assert got == {"a": (6, T0), "b": (2, None), "c": (3, None), "d": (7, None)}


def test_membership_and_lease(spark):
    h = lambda n: T0 + timedelta(hours=n)
    rows = [(1, 10, "member", h(0)), (1, 10, "member", h(1)), (1, 11, "member", h(2)), (1, None, "member", h(3)), (2, 10, "seed", h(0))]
    iv = ledger.membership_intervals(spark.createDataFrame(rows, "post_id long, hub_id long, role string, admitted_at timestamp"))
    assert {(r.post_id, r.hub_id, r.departed_at) for r in iv.collect()} == {(1, 10, h(2)), (1, 11, h(3)), (2, 10, None)}
    assert {r.post_id for r in ledger.members_at(iv, h(2.5)).where("hub_id = 11").collect()} == {1}
    box = spark.createDataFrame([(1, "pending", 0, None, None), (2, "leased", 1, h(-1), None), (3, "leased", 1, h(1), None), (4, "pending", 5, None, None), (5, "delivered", 1, None, None), (6, "pending", 0, None, h(5))], "id long, delivery_status string, attempts int, lease_until timestamp, available_at timestamp").withColumn("consumer", F.lit("")).withColumn("lease_token", F.lit(""))
    got = {r.id: (r.delivery_status, r.attempts) for r in ledger.lease(box, T0, "c", "t", 10).collect()}
    assert got == {1: ("leased", 1), 2: ("leased", 2), 3: ("leased", 1), 4: ("failed", 5), 5: ("delivered", 1), 6: ("pending", 0)}


def test_state_diff(spark):
    df = spark.createDataFrame([(1, '{"a": 1, "b": 2}', '{"b": 3, "c": 4}'), (2, None, '{"x": 1}'), (3, '{"y": 1}', '{"y": 1}')], "id long, before string, after string")
    assert {(r.id, r.field, r.change) for r in ledger.state_diff(df, "id", "before", "after").collect()} == {(1, "a", "removed"), (1, "b", "changed"), (1, "c", "added"), (2, "x", "added")}
