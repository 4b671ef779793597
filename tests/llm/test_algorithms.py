"""Distinctive terms, rank aggregation, frequencies and mixing against brute force."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from loomdex.llm import distinctive, frequency, mixing, ranking

POSTING = "term string, doc_id long, lc array<int>, tf_idf double, weight string"


def postings(seed, n=500):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        term = rng.choice(["hot", " Hot", "w%d" % rng.randrange(30), None, "  ", "é"])
        rows.append((term, rng.choice([rng.randrange(25), rng.randrange(25), 7, None]), rng.choice([[1], [1, 2, 3], [], None]), 9.9, "clash"))
    return rows + rows[:20]


def read(rows):
    out = {}
    for term, doc, lc, *_ in rows:
        t = term.strip().lower() if term else ""
        if t and doc is not None and lc:
            out[t, doc] = max(out.get((t, doc), 0), len(lc))
    return out


# ---------------------------------------------------------------- problem 2


def test_residuals(spark):
    rows = postings(1)
    pairs = read(rows)
    r, c = Counter(), Counter()
    for (t, d), n in pairs.items():
        r[d] += n
        c[t] += n
    total = sum(r.values())
    got = {(x.term, x.doc_id): x.weight for x in distinctive.score_terms(spark.createDataFrame(rows, POSTING)).collect()}
    assert set(got) == set(pairs)
    for (t, d), n in pairs.items():
        e = r[d] * c[t] / total
        assert got[t, d] == pytest.approx((n - e) / math.sqrt(e) / math.sqrt((1 - r[d] / total) * (1 - c[t] / total)))


def test_tf_idf_top_terms(spark):
    rows = postings(2)
    pairs = read(rows)
    df = Counter(t for t, _ in pairs)
    n_docs = len({d for _, d in pairs})
    want = defaultdict(list)
    for (t, d), n in pairs.items():
        want[d].append((-round((1 + math.log10(n)) * math.log10(n_docs / df[t]), 6), t))
    got = {(x.doc_id, x.term) for x in distinctive.top_terms(distinctive.score_terms(spark.createDataFrame(rows, POSTING), "tf_idf")).collect()}
    assert got == {(d, t) for d, ts in want.items() for _, t in sorted(ts)[:3]}


def test_distinctive_edges(spark):
    one = spark.createDataFrame([("a", 1, [1], None, "x")], POSTING)
    assert distinctive.score_terms(one).first().weight == 0 and distinctive.score_terms(one, "tf_idf").first().weight == 0
    assert distinctive.score_terms(one.limit(0)).count() == 0 and distinctive.score_terms(one.limit(0), "tf_idf").count() == 0
    with pytest.raises(ValueError):
        distinctive.score_terms(one, "bm25")


# ---------------------------------------------------------------- problem 5


def brute_ranks(values):
    ordered = sorted(values, reverse=True)
    return [ordered.index(v) + 1 + (ordered.count(v) - 1) / 2 for v in values]


@pytest.mark.parametrize(("heavy_rows", "weights"), [(10**6, None), (5, None), (10**6, [1.0, 5.0, 1.0])])
def test_median_ranks(spark, heavy_rows, weights):
    rng = random.Random(4)
    score = lambda s: rng.choice([None, float("nan"), rng.random() * s, rng.random() * s, 0.0])
    rows = [(q, d, score(1), score(1e6), score(1e-9), "x") for q in (1, 2) for d in range(30)] + [(None, 1, 1.0, 1.0, 1.0, "x"), (1, None, 1.0, 1.0, 1.0, "x")]
    df = spark.createDataFrame(rows + rows[:7], "q long, doc long, a double, b double, c double, median_rank string")
    got = {(r.q, r.doc): (r.median_rank, r.mean_rank) for r in ranking.median_ranks(df, ["q"], "doc", ["a", "b", "c"], weights, heavy_rows).collect()}
    w = weights or [1, 1, 1]
    clean = lambda v: float("-inf") if v is None or math.isnan(v) else v
    for q in (1, 2):
        mine = [r for r in rows if r[0] == q and r[1] is not None]
        columns = [brute_ranks([clean(r[2 + k]) for r in mine]) for k in range(3)]
        for i, r in enumerate(mine):
            ranks = [c[i] for c in columns]
            upto, median = 0, None
            for x, ww in sorted(zip(ranks, w)):
                upto += ww
                if median is None and upto >= sum(w) / 2:
                    median = x
            assert got[q, r[1]] == (median, pytest.approx(sum(x * ww for x, ww in zip(ranks, w)) / sum(w)))
    assert len(got) == 60


def test_ranges_do_not_dominate(spark):
    # document 1 is near the top everywhere, 2 leads two scores and is last in the third
    rows = [(1, 1, 9.0, 900.0, 0.9), (1, 2, 10.0, 1000.0, 0.0), (1, 3, 1.0, 1e9, 0.95), (1, 4, 8.0, 5.0, 0.5), (1, 5, 7.0, 4.0, 0.4), (1, 6, 6.0, 3.0, 0.3)]
    ranked = ranking.median_ranks(spark.createDataFrame(rows, "q long, doc long, a double, b double, c double"), ["q"], "doc", ["a", "b", "c"])
    assert ranking.first_items(ranked, ["q"], "doc", by="mean_rank").first().doc == 1
    assert ranking.first_items(ranked.limit(0), ["q"], "doc").count() == 0
    with pytest.raises(ValueError):
        ranking.median_ranks(ranked, ["q"], "doc", ["a"], [0.0])


# ---------------------------------------------------------------- problem 7


@pytest.mark.parametrize("share", [0.005, 0.2, 2.0])
def test_frequencies(spark, share):
    tables = {"a": postings(6), "b": postings(7, 60), "c": []}
    got = {(r.tbl, r.term): (r.occurrences, r.records, r.mark) for r in frequency.term_frequencies({k: spark.createDataFrame(v, POSTING) for k, v in tables.items()}, heavy_share=share).collect()}
    want = {}
    for name, rows in tables.items():
        pairs = read(rows)
        docs = len({d for _, d in pairs})
        for t in {t for t, _ in pairs}:
            ns = [n for (tt, _), n in pairs.items() if tt == t]
            want[name, t] = (sum(ns), len(ns), "rare" if len(ns) <= 2 else "common" if len(ns) >= 0.2 * docs else None)
    assert got == want
    assert frequency.term_frequencies({"c": spark.createDataFrame([], POSTING)}).count() == 0


# ---------------------------------------------------------------- problem 9


def mix_case(spark, heavy_rows, tilt):
    rng = random.Random(8)
    rows = [(i, rng.choice(["big"] * 6 + ["mid", "mid", "tiny", "other", None]), rng.choice([0, 5, 40, 300])) for i in range(400)]
    tokens = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("big", 0.5, 1), (" MID ", 0.3, 3), ("mid", 0.2, 2), ("tiny", 0.15, 2), ("none", 0.05, 4), (None, 0.3, 1), ("other", None, 1)], "source string, target_share double, max_passes int")
    plan = mixing.schedules(targets, tokens, tilt)
    return rows, plan, mixing.place(tokens, plan, heavy_rows)


@pytest.mark.parametrize(("heavy_rows", "tilt"), [(10**6, None), (20, {"big": -1.0, "mid": 0.7})])
def test_mix(spark, heavy_rows, tilt):
    rows, plan, placed = mix_case(spark, heavy_rows, tilt)
    own = Counter()
    for _, s, n in rows:
        own[s] += n
    shares, passes = {"big": 0.5, "mid": 0.3, "tiny": 0.15, "none": 0.05}, {"big": 1, "mid": 3, "tiny": 2, "none": 4}
    total = sum(own[s] for s in shares)
    copies = placed.collect()
    sums, seen = Counter(), defaultdict(set)
    for r in copies:
        sums[r.source] += r.n_tokens
        assert (r.doc_id, r["pass"]) not in seen[r.source] and 1 <= r["pass"] <= passes[r.source] and 0 <= r.position <= 1
        seen[r.source].add((r.doc_id, r["pass"]))
    report = {r.source: r for r in mixing.report(placed, plan).collect()}
    assert set(report) == set(shares)
    for s, share in shares.items():
        wanted = share * total
        if passes[s] * own[s] < wanted:
            assert report[s].short and sums[s] == passes[s] * own[s]
        else:
            assert not report[s].short and wanted <= sums[s] < wanted + 301
        assert report[s].reached_tokens == sums[s] and report[s].own_tokens == own[s]
    assert sum(r.actual_share for r in report.values()) == pytest.approx(1)
    # at any time the tokens placed so far follow the integral of the schedule
    slope = (tilt or {}).get("mid", 0.0)
    for t in (0.25, 0.5, 0.75):
        due = 0.3 * total * (t + slope * (t * t - t))
        assert abs(sum(r.n_tokens for r in copies if r.source == "mid" and r.position < t) - due) <= 301
    order = [(r.position, r.source) for r in placed.orderBy("position", "source").collect()]
    assert order == sorted(order)


def test_mix_of_nothing(spark):
    tokens = spark.createDataFrame([], "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_passes int")
    plan = mixing.schedules(targets, tokens)
    placed = mixing.place(tokens, plan)
    assert placed.count() == 0 and mixing.report(placed, plan).first().actual_share == 0
    assert mixing.report(mixing.place(tokens, plan.limit(0)), plan.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mixing.schedules(targets, tokens, {"a": 2.0})


def test_token_table(spark):
    docs = spark.createDataFrame([(1, " Wiki ", "two words", "x"), (2, None, None, "x"), (3, "wiki", "", "x")], "doc_id long, source string, text string, n_tokens string")
    assert sorted((r.doc_id, r.source, r.n_tokens) for r in mixing.token_table(docs).collect()) == [(1, "wiki", 2), (2, None, 0), (3, "wiki", 0)]


def test_positions_invert_demand(spark):
    w, upto = [0.0, 10.0, 0.0], [0.0, 2.5, 5.0]  # a triangle over 0..1
    df = spark.range(0, 51).select((F.col("id") / 10).alias("c"))
    for r in df.select("c", mixing.position(F.col("c"), F.lit(w), F.lit(upto)).alias("t")).collect():
        t = r.t
        demand = 10 * t * t if t <= 0.5 else 5 - 10 * (1 - t) ** 2
        assert demand == pytest.approx(r.c, abs=1e-9)


def test_heavy_terms_are_sketched_and_light_ones_shuffled_once(spark):
    rng = random.Random(4)
    rows = [("hot" if rng.random() < 0.4 else f"t{rng.randrange(3000)}", i, [1]) for i in range(6_000)]
    df = spark.createDataFrame(rows, "term string, doc_id long, lc array<int>")
    marked = frequency.usable_rows(df).withColumn("tbl", F.lit("p"))
    assert ("p", "hot") in frequency.heavy_terms(marked) and len(frequency.heavy_terms(marked)) <= 1 / frequency.HEAVY_SHARE
    both = marked.unionByName(marked.withColumn("tbl", F.lit("q")))
    plan = frequency._light(both)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "hashpartitioning(tbl" in plan


def test_sources_lean_by_their_shares(spark):
    tokens = spark.createDataFrame([(i, s, 10) for i, s in enumerate("aabbcc")], "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 1), ("c", 0.2, 1)], "source string, target_share double, max_passes int")
    slope = {r.source: (r.w[-1] - r.w[0]) / (r.w[-1] + r.w[0]) for r in mixing.schedules(targets, tokens, {"b": 0.3}, lean=0.5).collect()}
    assert slope == {"a": pytest.approx(-0.5), "b": pytest.approx(0.3), "c": pytest.approx(0.5)}
    with pytest.raises(ValueError):
        mixing.schedules(targets, tokens, lean=2.0)
