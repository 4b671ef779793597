"""Dangling references, hot keys, hierarchies and running sums against brute force."""

import math
import random
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from loomdex.functions.read import current_pages, target, term, usable
from loomdex.operators import hierarchy, orphans, quantiles, running
from loomdex.plans import problems

REF = "field string, src_id long, space string, key string, at long"
SPAN = "space string, key string, begins long, ends long"
DAY = 86_400_000_000
START = 18_700 * DAY


# ---------------------------------------------------------------- readers


def test_targets_and_terms(spark):
    rows = [(" A_b#x|y ",), ("|x",), ("",), (None,), ("\t Q  ",), ("_ _",)]
    got = [tuple(r) for r in spark.createDataFrame(rows, "x string").select(target(F.col("x")), term(F.col("x"))).collect()]
    assert got == [("A b", "a_b#x|y"), (None, "|x"), (None, None), (None, None), ("Q", "q"), (None, "_ _")]


def test_usable_rows(spark):
    rows = [("A ", 1, [1, 2], "x"), ("a", 1, [3], "y"), ("a", None, [1], "z"), (None, 1, [1], "z"), (" ", 1, [1], "z"), ("b", 1, [], "z"), ("b", 2, None, "z"), ("a", 1, [5, 6], "x")]
    df = spark.createDataFrame(rows, "term string, doc_id long, lc array<int>, n string")
    assert [tuple(r) for r in usable(df).collect()] == [("a", 1, 2)] and usable(df.limit(0)).count() == 0


def test_current_pages(spark):
    rows = [(1, "a", None, "2021-01-01", "2021-01-02"), (1, "b", None, "2021-01-01", "2021-01-03"), (1, "c", None, None, "2022-01-01"), (None, None, None, "2023-01-01", None), (2, "x", None, None, None), (2, "x", None, None, None)]
    df = spark.createDataFrame(rows, "id long, title string, redirect string, edited_at string, loaded_at string")
    assert sorted((r.id, r.title) for r in current_pages(df).collect()) == [(1, "b"), (2, "x")]


# ---------------------------------------------------------------- running sums


@pytest.mark.parametrize("heavy_rows", [10, 10**6])
def test_running_sum(spark, heavy_rows):
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), i % 37, i, rng.choice([1, 2, None])) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, o long, i long, v long")
    want, sums = {}, {}
    for g, o, i, v in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        sums[g] = sums.get(g, 0) + (v or 0)
        want[i] = sums[g]
    got = running.running_sum(df, ["g"], ["o", "i"], {"upto": "v"}, heavy_rows, ranges=8)
    assert {r.i: r.upto for r in got.collect()} == want and running.running_sum(df.limit(0), ["g"], ["o", "i"], {"upto": "v"}).count() == 0


@pytest.mark.parametrize("heavy_rows", [5, 10**6])
def test_mean_ranks(spark, heavy_rows):
    df = spark.createDataFrame([("q", float(v)) for v in [5, 5, 5, 3, 1, 1, float("-inf"), *range(10, 30)]], "g string, v double")
    got = {r.v: r.rank for r in running.mean_ranks(df, ["g"], "v", heavy_rows).collect()}
    assert got[29.0] == 1 and got[5.0] == 22 and got[3.0] == 24 and got[1.0] == 25.5 and got[float("-inf")] == 27


# ---------------------------------------------------------------- dangling references


def brute_orphans(refs, spans):
    out = set()
    for field, src, space, key, at in set(refs):
        if key is None or at is None:
            continue
        own = {(b, e) for s, k, b, e in spans if (s, k) == (space, key)}
        if any((b is None or b <= at) and (e is None or e > at) for b, e in own):
            continue
        reason = "missing" if not own else "deleted" if any(e is not None and e <= at for _, e in own) else "late"
        out.add((field, src, key, reason))
    return out


def random_case(seed, n=400):
    rng = random.Random(seed)
    key = lambda: rng.choice(["hot", "hot", f"k{rng.randrange(25)}", None])
    time = lambda: START + rng.randrange(900) * DAY // 3
    refs = [(rng.choice(["a", "b"]), rng.randrange(40), rng.choice(["t", "i"]), key(), rng.choice([time(), time(), time(), None])) for _ in range(n)]
    spans = []
    for _ in range(60):
        b, e = sorted((time(), time()))
        spans.append((rng.choice(["t", "i"]), key(), rng.choice([b, b, None]), rng.choice([e, None])))
    spans += rng.sample(spans, 10) + [("t", "k1", START + 5 * DAY, START + 2 * DAY), ("t", "k2", START + DAY, START + DAY)]
    return refs + refs[:30], spans


@pytest.mark.parametrize(("seed", "months"), [(1, 1000), (2, 4), (3, 2)])
def test_ledger_matches_brute_force(spark, seed, months):
    refs, spans = random_case(seed)
    ledger = orphans.run_ledger(spark.createDataFrame(refs, REF), spark.createDataFrame(spans, SPAN), months)
    got = {(r.field, r.src_id, r.key, r.reason) for r in ledger.report().collect()}
    assert got == brute_orphans(refs, spans)


@pytest.mark.parametrize("many", [2, 500])
def test_ledger_with_a_hot_changing_key(spark, monkeypatch, many):
    from functools import partial

    monkeypatch.setattr(orphans, "MANY_CHANGES", many)

    monkeypatch.setattr(orphans, "running_sum", partial(running.running_sum, heavy_rows=20, ranges=8))
    refs = [("a", i, "t", "hot", START + i * DAY // 10) for i in range(500)]
    spans = [("t", "hot", START + k * 10 * DAY, START + (k * 10 + 5) * DAY) for k in range(1, 5)]
    ledger = orphans.run_ledger(spark.createDataFrame(refs, REF), spark.createDataFrame(spans, SPAN), 1000)
    assert {(r.field, r.src_id, r.key, r.reason) for r in ledger.report().collect()} == brute_orphans(refs, spans)


def test_arrivals_resolve_and_deletions_reopen(spark):
    ledger = orphans.OrphanLedger(spark)
    changes = lambda *rows: orphans.span_changes(spark.createDataFrame(list(rows), SPAN))
    refs = lambda *rows: spark.createDataFrame(list(rows), REF)
    none = changes().limit(0)
    state = lambda: {(r.key, r.reason, r.open) for r in ledger.report().collect()}
    ledger.advance(refs(("a", 1, "t", "k", START)), none, START + 1)
    assert state() == {("k", "missing", True)}
    ledger.advance(refs(), changes(("t", "k", START + 2, None)), START + 3)
    assert state() == {("k", "late", False)}
    ended = spark.createDataFrame([("t", "k", START + 4, 0, -1, 1)], "space string, key string, at long, begun int, opened int, ended int")
    ledger.advance(refs(), ended, START + 5)
    assert state() == {("k", "late", True)}
    ledger.advance(refs(("a", 2, "t", "k", START + 6)), none, START + 7)
    assert state() == {("k", "late", True), ("k", "deleted", True)}
    counts = {(r.as_of - START, r.reason, r.open): r.n for r in ledger.snapshots.collect()}
    assert counts == {(1, "waiting", True): 1, (3, "late", False): 1, (5, "late", True): 1, (7, "late", True): 1, (7, "deleted", True): 1}
    assert {r.month for r in ledger.report().collect()} == {"2021-03"}


def test_ledger_of_nothing(spark):
    ledger = orphans.run_ledger(spark.createDataFrame([], REF), spark.createDataFrame([], SPAN))
    assert ledger.report().count() == 0 and ledger.snapshots.count() == 0


def test_page_references_skip_what_is_none(spark):
    rows = [(1, "B#x", ["A_b", None, "", "#top"], "2021-01-01"), (2, None, None, "2021-01-01"), (None, "Q", ["Q"], "2021-01-01")]
    df = spark.createDataFrame(rows, "id long, redirect string, links array<string>, edited_at string")
    assert sorted((r.field, r.src_id, r.key) for r in problems.page_references(df).collect()) == [("pages.links", 1, "A b"), ("pages.redirect", 1, "B")]


@pytest.mark.parametrize(("seed", "months"), [(4, 24), (5, 5)])
def test_monthly_snapshots_match_brute_force(spark, seed, months):
    from collections import Counter

    refs, spans = random_case(seed, 150)
    refs.append(("a", 99, "t", "brief", START + DAY))  # opens and is resolved inside one period
    spans.append(("t", "brief", START + 70 * DAY, None))
    ledger = orphans.run_ledger(spark.createDataFrame(refs, REF), spark.createDataFrame(spans, SPAN), months)
    month = lambda t: datetime.fromtimestamp(t / 10**6, UTC)
    own = lambda r: {(b, e) for s, k, b, e in spans if (s, k) == (r[2], r[3])}
    lost = [r for r in set(refs) if r[3] is not None and r[4] is not None and not any((b is None or b <= r[4]) and (e is None or e > r[4]) for b, e in own(r))]
    known = [r[4] for r in refs if r[3] is not None and r[4] is not None]
    final = max(known + [t for s in spans for t in s[2:] if t is not None and s[1] is not None])
    want, y, m = Counter(), month(min(known)).year, month(min(known)).month
    while True:
        y, m = y + m // 12, m % 12 + 1
        end = int(datetime(y, m, 1, tzinfo=UTC).timestamp()) * 10**6
        for r in lost:
            if r[4] < end:
                seen = [(b, e) for b, e in own(r) if (b is None or b < end) and (b is None or e is None or b < e or e < end)]
                there = any(e is None or (e >= end and (b is None or b < e)) for b, e in seen)
                reason = "deleted" if any(e is not None and e <= r[4] for b, e in own(r)) else "late" if any(b is None or e is None or b < e or e < end for b, e in seen) else "waiting"
                want[end, r[0], f"{month(r[4]):%Y-%m}", reason, not there] += 1
        if end > final:
            break
    got = {tuple(r)[:5]: r.n for r in orphans.monthly_snapshots(ledger).collect()}
    assert got == dict(want)
    assert got[int(datetime(2021, 4, 1, tzinfo=UTC).timestamp()) * 10**6, "a", "2021-03", "waiting", True] >= 1


# ---------------------------------------------------------------- quantiles


@pytest.mark.parametrize("hot_rows", [0, 40, 10**6])
def test_quantiles(spark, hot_rows):
    rng = random.Random(5)
    rows = [(rng.choice(["hot"] * 5 + ["a", "b", None]), rng.choice([None, rng.randrange(-(10**9), 10**9), rng.randrange(5), 2**60])) for _ in range(900)]
    rows += [("empty", None), ("one", 7)]
    df = spark.createDataFrame(rows, "k string, v long").withColumn("n", F.lit("clash")).withColumn("total", F.lit(1))
    probs = [0.0, 0.25, 0.5, 0.99, 1.0]
    got = {r.k: tuple(r)[1:] for r in quantiles.per_key_quantiles(df, ["k"], "v", probs, hot_rows=hot_rows, bins=16).collect()}
    keys = {k for k, _ in rows if k is not None}
    total = sum(k is not None for k, _ in rows)
    for k in keys:
        vs = sorted(v for kk, v in rows if kk == k and v is not None)
        want = [vs[max(1, math.ceil(p * len(vs))) - 1] if vs else None for p in probs]
        assert got[k] == (sum(kk == k for kk, _ in rows), total, *want), k
    assert set(got) == keys


def test_quantiles_by_share_and_empty(spark):
    df = spark.createDataFrame([("f", "x", 1)] * 98 + [("f", "y", 2)] * 2 + [("g", "z", 3)], "f string, k string, v long")
    got = quantiles.per_key_quantiles(df, ["f", "k"], "v", [0.5], ["f"], min_share=0.03, hot_rows=10)
    assert sorted((r.f, r.k, r.n, r.total, r.q0) for r in got.collect()) == [("f", "x", 98, 100, 1), ("g", "z", 1, 1, 3)]
    assert quantiles.per_key_quantiles(df.limit(0), ["f", "k"], "v", [0.5]).count() == 0


# ---------------------------------------------------------------- hierarchies


def brute_tree(links):
    parent = {}
    for a, b in links:
        if a is not None and b is not None:
            parent[a] = min(b, parent.get(a, b))
    out = {}
    for x in parent:
        path, at = [x], x
        while at in parent and parent[at] not in path[:-1] and len(path) <= len(parent) + 1:
            at = parent[at]
            path.append(at)
        out[x] = (-1, -1, None) if at in parent else (at, len(path) - 1, path[::-1])
    return out


@pytest.mark.parametrize(("seed", "every", "hubs"), [(1, 16, 1000), (2, 2, 3), (3, 1, 2), (4, 10**6, 1000)])
def test_hierarchy(spark, seed, every, hubs):
    rng = random.Random(seed)
    links = [(i, rng.randrange(max(1, i - 30), i)) for i in range(2, 120)]  # trees
    links += [(200 + i, 201 + i) for i in range(90)]  # a long chain
    links += [(400 + i, 400 + (i + 1) % 7) for i in range(7)] + [(420, 403), (421, 420)]  # a loop and ways into it
    links += [(500, 500), (501, 500)] + [(600 + i, 1) for i in range(20)]  # its own parent; a hub
    links += [(700, None), (None, 1), (5, 4), (5, 4)]
    df = spark.createDataFrame([(a, b, "x") for a, b in links], "node long, parent long, root string")
    got = {r.node: (r.root, r.depth, r.path) for r in hierarchy.resolve(df, every=every, hub_children=hubs, with_path=True).collect()}
    want = brute_tree(links)
    assert got == want
    plain = {r.node: (r.root, r.depth) for r in hierarchy.resolve(df, every=every, hub_children=hubs).collect()}
    assert plain == {k: v[:2] for k, v in want.items()}


def test_descendants(spark):
    solved = hierarchy.resolve(spark.createDataFrame([(2, 1), (3, 2), (4, 2), (9, 9)], "node long, parent long"), with_path=True)
    assert sorted(map(tuple, hierarchy.descendants(solved).collect())) == [(1, 2, 1), (1, 3, 2), (1, 4, 2), (2, 3, 1), (2, 4, 1)]
    assert hierarchy.resolve(spark.createDataFrame([], "node long, parent long")).count() == 0


def brute_ways(links):
    parent, out = dict(links), {}
    for x in parent:
        way, at = [], x
        while at in parent and parent[at] not in way:
            at = parent[at]
            way.append(at)
        if at in parent:
            out[x] = way
    return out


def test_every_page_has_a_row_and_loops_have_descendants(spark, tmp_path):
    # 3 -> 2 -> 1; cycle 10 -> 11 -> 12 -> 10 with the tail 21 -> 20 -> 10; 30 its own; 40 alone
    links = [(2, 1), (3, 2), (10, 11), (11, 12), (12, 10), (20, 10), (21, 20), (30, 30)]
    to = dict(links)
    rows = [(i, f"t{i}", f"t{to[i]}" if i in to else None, "2021-01-01", "2021-01-01") for i in (1, 2, 3, 10, 11, 12, 20, 21, 30, 40)]
    spark.createDataFrame(rows, "id long, title string, redirect string, edited_at string, loaded_at string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.root_id, r.node_depth, r.path, r.descendants, r.loop) for r in problems.p6_pages(spark, str(tmp_path)).collect()}
    assert got == {1: (1, 0, "1", 2, False), 2: (1, 1, "1/2", 1, False), 3: (1, 2, "1/2/3", 0, False), 40: (40, 0, "40", 0, False), 30: (-1, -1, "30", 0, True),
                   10: (-1, -1, "12/11/10", 4, True), 11: (-1, -1, "10/12/11", 4, True), 12: (-1, -1, "11/10/12", 4, True), 20: (-1, -1, "12/11/10/20", 1, True), 21: (-1, -1, "12/11/10/20/21", 0, True)}
    pairs = {(r.page_id, r.descendant_id, r.distance) for r in problems.p6_pairs(spark, str(tmp_path)).where("loop").collect()}
    assert pairs == {(a, x, i + 1) for x, way in brute_ways(links).items() for i, a in enumerate(way) if a != x}


def test_loop_ways_match_brute_force(spark):
    rng = random.Random(7)
    links = [(i, rng.randrange(60)) for i in range(60)] + [(100 + i, 100 + (i + 1) % 37) for i in range(37)] + [(200 + i, 201 + i) for i in range(50)] + [(250, 103)]
    df = spark.createDataFrame(links, "node long, parent long")
    assert {r.node: r.way for r in hierarchy.loop_ways(df, hierarchy.resolve(df)).collect()} == brute_ways(links)


# ---------------------------------------------------------------- hot keys


@pytest.mark.parametrize(("share", "seed"), [(0.02, 1), (0.3, 2), (1.0, 3), (0.0005, 4)])
def test_hot_keys_match_a_full_count(spark, share, seed):
    from collections import Counter

    rng = random.Random(seed)
    rows = [(rng.choice("fg"), rng.choice(["hot"] * 3 + [f"k{rng.randrange(12)}", f"x{rng.randrange(400)}", None])) for _ in range(2_000)] + [("h", "only")] * 2 + [(None, "hot")]
    df = spark.createDataFrame(rows, "f string, k string").withColumn("n", F.lit("clash")).withColumn("total", F.lit(1))
    counts = Counter((f, k) for f, k in rows if f is not None and k is not None)
    totals = Counter(f for f, k in rows if k is not None)
    want = {(f, k, n, totals[f]) for (f, k), n in counts.items() if n >= share * totals[f]}
    got = quantiles.hot_keys(df, ["k"], ["f"], share, bins=16).collect()
    assert {(r.f, r.k, r.n, r.total) for r in got} == want and len(got) == len(want)
    assert quantiles.hot_keys(df.limit(0), ["k"], ["f"], share).count() == 0


def test_quantiles_reject_what_is_not_whole(spark):
    with pytest.raises(TypeError):
        quantiles.per_key_quantiles(spark.createDataFrame([("a", 1.5)], "k string, v double"), ["k"], "v", [0.5])
    extremes = spark.createDataFrame([("a", v) for v in (-(2**63), 2**63 - 1, 0, -1, 5)], "k string, v long")
    assert [r.q0 for r in quantiles.per_key_quantiles(extremes, ["k"], "v", [0.5], hot_rows=1).collect()] == [0]


def test_hot_keys_are_found_by_histograms_alone(spark):
    from conftest import DATA

    plan = problems.p4_found(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    # only keys at a selected rank are counted: the filter on them stands below the aggregate
    assert plan.index("HashAggregate") < plan.index("Join") and plan.count("Join") == 1
