import random
from collections import Counter

import numpy as np
import pytest

from tonarm.operators import profile, quantiles, sketches


def top(rows, k):
    out = set()
    for g in {g for g, _ in rows}:
        counts = Counter(x for h, x in rows if h == g and x is not None)
        out |= {(g, x, n, i + 1) for i, (x, n) in enumerate(sorted(counts.items(), key=lambda t: (-t[1], t[0]))[:k])}
    return out


@pytest.mark.parametrize("flat", [False, True])
def test_heavy_hitters(spark, monkeypatch, flat):
    """Few counters: proven by their errors where some items are frequent; where none is, they grow until all is counted."""
    rng = random.Random(1)
    names = [f"i{x}" for x in range(400)]
    rows = [(rng.choice(["a", "b", None]), x) for x in rng.choices(names, [1] * 400 if flat else [1000 / (i + 1) ** 1.6 for i in range(400)], k=6_000)]
    rows += [("a", None), ("c", None), ("d", "only")]
    df = spark.createDataFrame(rows, "g string, x string").repartition(3)
    used = []
    real = sketches._sketched
    monkeypatch.setattr(sketches, "_sketched", lambda d, c: (used.append(c), real(d, c))[1])
    got = {tuple(r) for r in sketches.heavy_hitters(df, "x", 4, "g", capacity=40).collect()}
    assert got == top(rows, 4)
    assert used == ([40, 320] if flat else [40])
    monkeypatch.setattr(sketches, "MOST", 100)  # counts all items in the end
    assert {tuple(r) for r in sketches.heavy_hitters(df, "x", 4, "g", capacity=40).collect()} == top(rows, 4)
    assert sketches.heavy_hitters(df.limit(0), "x", 4).count() == 0


def test_counters_bound_counts():
    rng = random.Random(2)
    said = rng.choices(range(300), [1 / (i + 1) for i in range(300)], k=20_000)
    c = sketches.Counters(25)
    for i in range(0, len(said), 500):
        part = Counter(said[i : i + 500])
        c.add(part.keys(), part.values())
    c.shrink()
    true = Counter(said)
    assert len(c.counts) <= 25 and c.error <= len(said) / 26
    assert all(c.counts.get(x, 0) <= n <= c.counts.get(x, 0) + c.error for x, n in true.items())


def test_sample_equals_sorted_sample(spark):
    df = spark.createDataFrame([(i, ["x", "y", None][i % 3], i % 50) for i in range(500)], "k long, g string, w int").repartition(4)
    got = sketches.stratified_sample(df, "k", 7, "g", 3)
    assert {r["k"] for r in got.collect()} == {r["k"] for r in profile.inspection_sample(df, "k", 7, 3, "g").collect()}
    assert {r["k"] for r in sketches.stratified_sample(df, "k", 9).collect()} == {r["k"] for r in profile.inspection_sample(df, "k", 9).collect()}
    above, below = got._jdf.queryExecution().sparkPlan().toString().split("MapInArrow")
    assert "Window" in above and "Sort" not in below and "Window" not in below  # only what tasks keep is sorted
    assert got.columns == df.columns and sketches.stratified_sample(df.limit(0), "k", 7, "g").count() == 0


def test_weighted_sample(spark):
    """Over many seeds, a row of weight 3 is drawn about three times as often as one of weight 1, one of weight 0 never."""
    df = spark.createDataFrame([(i, [3.0, 1.0, 0.0, None][i % 4]) for i in range(80)], "k long, w double")
    seen = Counter()
    one = None
    for seed in range(12):
        part = sketches.stratified_sample(df, "k", 5, None, seed, "w")
        one = part if one is None else one.union(part)
    for r in one.collect():
        seen[r["w"]] += 1
    assert set(seen) == {3.0, 1.0} and sum(seen.values()) == 60 and 1.5 < seen[3.0] / seen[1.0] < 7


def test_quantiles(spark, monkeypatch):
    rng = np.random.default_rng(4)
    monkeypatch.setattr(quantiles, "BINS", 16)
    groups = {
        "flat": rng.uniform(-5, 5, 400), "far": np.r_[10.0 ** rng.uniform(-300, 300, 99), -(10.0 ** rng.uniform(0, 300, 52))], "same": np.full(50, 2.5), "one": np.array([7.0]),
        "two": np.array([1.0, 2.0]), None: rng.integers(0, 4, 77).astype(float), "ends": np.array([-1.7e308, 1.7e308, 0.0, 5.0]),
    }
    rows = [(g, float(x)) for g, v in groups.items() for x in v] + [("flat", None), ("flat", float("nan")), ("one", float("inf")), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    wanted = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}
    got = {r["g"]: r for r in quantiles.exact_quantiles(df, "x", wanted, "g").collect()}
    assert set(got) == set(groups)
    for g, v in groups.items():
        v = np.sort(v)
        assert got[g]["n"] == len(v)
        for name, p in wanted.items():
            at = p * (len(v) - 1)
            low, high = v[int(np.floor(at))], v[int(np.ceil(at))]
            assert got[g][name] == pytest.approx(low + (high - low) * (at - np.floor(at)), rel=1e-12)
    assert quantiles.exact_quantiles(df.where("x IS NULL"), "x", wanted).count() == 0


def test_box_of_all(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("b", 100), (None, 4)], "g string, x int")
    assert [tuple(r) for r in profile.box_stats(df, None, "x").collect()] == [(2.0, 3.0, 4.0, 1.0, 4.0)]
    got = {r["g"]: (r["median"], r["high"]) for r in profile.box_stats(df, "g", "x").collect()}
    assert got == {"a": (1.5, 2.0), "b": (51.5, 100.0), None: (4.0, 4.0)}
