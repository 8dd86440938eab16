"""Late events, hierarchies and components."""

from __future__ import annotations

import random
from collections import defaultdict
from datetime import datetime, timedelta

from hypothesis import given, settings
from hypothesis import strategies as st

from tideloom.operators.graph import connected_components
from tideloom.operators.hierarchy import ancestor_pairs, nested_sets
from tideloom.operators.late_events import FingerBTree, event_time_counts

T0 = datetime(2026, 3, 1)
EVENT = "id long, at timestamp, got timestamp, k long, p long, fate string"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 300), st.integers(0, 1)), max_size=400), st.integers(4, 9), st.lists(st.integers(0, 300), max_size=5))
def test_tree_equals_a_dictionary(rows, order, floors):
    tree, plain, closed, floor = FingerBTree(order), defaultdict(lambda: [0, 0]), {}, -1
    cuts = sorted(floors)
    for i, (p, slot) in enumerate(rows):
        if cuts and i % 50 == 49:
            low = cuts.pop(0)
            got = {k: (a, b) for k, a, b, _ in tree.evict(low)}
            want = {k: tuple(v) for k, v in plain.items() if k <= low}
            assert got == want
            closed.update(want)
            for k in want:
                del plain[k]
            floor = max(floor, low)
        if tree.add(p, slot):
            assert p > floor
            plain[p][slot] += 1
        else:
            assert p <= floor
    assert {k: (a, b) for k, a, b, _ in tree} == {k: tuple(v) for k, v in plain.items()}
    assert tree.total(50, 200)[:2] == [sum(v[j] for k, v in plain.items() if 50 <= k <= 200) for j in (0, 1)]
    assert [x[0] for x in tree] == sorted(plain)


def events(spark, rows):
    return spark.createDataFrame([(i, at, got, 7, 7, "x") for i, at, got in rows], EVENT)


def test_fates_and_cut_off(spark):
    end = T0 + timedelta(hours=1)
    rows = [(1, T0, end + timedelta(minutes=15)), (2, T0, end + timedelta(minutes=15, microseconds=1)), (3, T0, end + timedelta(hours=24)), (4, T0, end + timedelta(hours=24, microseconds=1)), (5, T0, T0 - timedelta(days=3)), (6, None, end), (7, T0, None), (None, T0, end)]
    got = {r.id: r.fate for r in event_time_counts(events(spark, rows), "id", "at", "got", emit="records").collect()}
    assert got == {1: "on_time", 2: "amends", 3: "amends", 4: "refused", 5: "on_time"}
    one = event_time_counts(events(spark, rows), "id", "at", "got").collect()
    assert [(r.period_start, r.on_time, r.amended, r.refused) for r in one] == [(T0, 2, 2, 1)]


def test_late_events_empty_ties_and_hot_period(spark):
    assert event_time_counts(events(spark, []), "id", "at", "got").count() == 0
    rnd = random.Random(3)
    rows = [(i, T0 if i % 3 else T0 + timedelta(hours=rnd.randrange(60)), T0 + timedelta(hours=rnd.randrange(90))) for i in range(900)] + [(1, T0, T0)] * 5
    got = event_time_counts(events(spark, rows), "id", "at", "got")
    want = defaultdict(lambda: [0, 0, 0])
    for _, at, rec in rows:
        hour = at.replace(minute=0)
        end = hour + timedelta(hours=1)
        want[hour][0 if rec <= end + timedelta(minutes=15) else 1 if rec <= end + timedelta(hours=24) else 2] += 1
    assert {r.period_start: [r.on_time, r.amended, r.refused] for r in got.collect()} == dict(want)


def brute(parent):
    out = {}
    for n in parent:
        path, seen = [n], {n}
        while parent.get(path[-1]) in parent:
            nxt = parent[path[-1]]
            if nxt in seen:
                path = None
                break
            seen.add(nxt)
            path.append(nxt)
        out[n] = path[::-1] if path else None
    return out


def test_hierarchy_against_brute_force(spark):
    rnd = random.Random(5)
    parent = {i: (rnd.randrange(max(0, i - 4), i) if i % 9 else None) for i in range(1, 160)}
    parent |= {500: 501, 501: 502, 502: 500, 503: 502, 600: 600, 700: 9999, 800: None}
    rows = [(k, v, "x", 1) for k, v in parent.items()] + [(1, parent[1], "y", 2), (None, 3, "z", 0)]
    got = {r.id: r for r in nested_sets(spark.createDataFrame(rows, "id long, parent_id long, root string, depth int"), order_buckets=4).collect()}
    want = brute(parent)
    assert set(got) == set(parent)
    below = defaultdict(set)
    for n, path in want.items():
        for a in (path or [])[:-1]:
            below[a].add(n)
    for n, path in want.items():
        r = got[n]
        if path is None:
            assert (r.on_ring, r.root, r.depth, r.path) == (True, -1, -1, None)
        else:
            assert (r.on_ring, r.root, r.depth, list(r.path), r.size) == (False, path[0], len(path) - 1, path, len(below[n]) + 1)
            inside = {m for m, p in want.items() if p and p[0] == path[0] and r.left_at < got[m].left_at <= r.right_at}
            assert inside == below[n]


def test_deep_chain_and_empty(spark):
    chain = [(i, i - 1 if i else None) for i in range(300)]
    got = {r.id: r.depth for r in nested_sets(spark.createDataFrame(chain, "id long, parent_id long")).collect()}
    assert got == {i: i for i in range(300)}
    none = nested_sets(spark.createDataFrame([], "id long, parent_id long"))
    assert none.count() == 0 and ancestor_pairs(none).count() == 0


def test_components(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(400 + i, 401 + i) for i in range(40)] + [(5, 5), (None, 3)]
    lead = {}

    def find(x):
        while lead.setdefault(x, x) != x:
            x = lead[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = sorted((find(a), find(b)))
            lead[y] = x
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: find(x) for x in lead}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0
