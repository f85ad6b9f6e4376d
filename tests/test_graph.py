"""Commit graphs against plain walks: forks, merges, several roots, unknown parents, lists over shared remotes; running values over blocks."""

import random

import pytest
from pyspark.sql import functions as F

from palisade.functions.scans import running
from palisade.sources import graph


def random_history(seed, n=160):
    random.seed(seed)
    parents, dates = {}, {}
    for c in range(n):
        near = [x for x in range(max(0, c - 12), c)]
        k = 0 if not near or random.random() < 0.03 else min(len(near), random.choice([1, 1, 1, 2, 3]))
        parents[c] = ([c - 1] if k and random.random() < 0.6 else random.sample(near, 1) if k else []) + []
        while len(parents[c]) < k:
            parents[c] = list(dict.fromkeys([*parents[c], random.choice(near)]))
            if len(set(near)) == len(parents[c]):
                break
        dates[c] = 1000 * c - random.choice([0, 0, 0, 30_000])
    return parents, dates


def ancestors(parents, tips):
    seen, todo = set(), list(tips)
    while todo:
        c = todo.pop()
        if c not in seen and c in parents:
            seen.add(c)
            todo += parents[c]
    return seen


def frames(spark, parents, dates):
    ids = {c: (c * 37) % 1009 for c in parents}  # ids say nothing about the order
    rows = spark.createDataFrame([(ids[c], dates[c]) for c in parents], "commit long, at long")
    edges = spark.createDataFrame([(ids[c], ids.get(p, 5000), n) for c, ps in parents.items() for n, p in enumerate(ps)] + [(ids[0], 7777, 0)], "child long, parent long, ord int")
    return ids, rows, edges


@pytest.mark.parametrize(("seed", "step"), [(1, 1000), (2, 3)])
def test_reachable_and_listed(spark, monkeypatch, seed, step):
    monkeypatch.setattr(graph, "STEP", step)
    parents, dates = random_history(seed)
    ids, rows, edges = frames(spark, parents, dates)
    known = graph.chained(rows, edges)
    back = {v: k for k, v in ids.items()}
    # Places count up along first parents, each chain without gaps.
    places = {back[r["commit"]]: (r["chain"], r["place"]) for r in known.places.collect()}
    assert len(places) == len(parents)
    for c, (chain, place) in places.items():
        if place:
            assert places[parents[c][0]] == (chain, place - 1)
    right = {}
    for c in range(len(parents)):
        right[c] = max([dates[c], *(right[p] + 1 for p in parents[c])])
    at = graph.corrected(known, rows)
    assert {back[r["commit"]]: r["at"] for r in at.collect()} == right
    wants = [("a", "x", 159), ("b", "x", 120), ("b", "x", 80), ("c", "y", 150), ("none", "y", 5), ("all", "z", 159)]
    unwanted = [("x", 100), ("x", 60), ("y", 140), ("y", 5)]
    named = lambda rows_, schema: spark.createDataFrame([(*r[:-1], ids[r[-1]]) for r in rows_] + [(*rows_[0][:-1], 9999)], schema)
    got = graph.rev_list(known, named(wants, "key string, over string, commit long"), named(unwanted, "over string, commit long"), at).collect()
    lists = {}
    for r in sorted(got, key=lambda r: (r["key"], r["ordinal"])):
        assert r["ordinal"] == len(lists.setdefault(r["key"], [])) + 1
        lists[r["key"]].append(back[r["commit"]])
    for key in {w[0] for w in wants}:
        over = next(w[1] for w in wants if w[0] == key)
        left = ancestors(parents, [w[2] for w in wants if w[0] == key]) - ancestors(parents, [u[1] for u in unwanted if u[0] == over])
        want = sorted((c for c in left if len(parents[c]) < 2), key=lambda c: (right[c], ids[c]))
        assert lists.get(key, []) == want
        place = {c: i for i, c in enumerate(lists.get(key, []))}
        assert all(place[p] < place[c] for c in place for p in parents[c] if p in place)


def test_no_commits(spark):
    known = graph.chained(spark.createDataFrame([], "commit long"), spark.createDataFrame([], "child long, parent long, ord int"))
    tips = spark.createDataFrame([("a", "x", 1)], "key string, over string, commit long")
    assert graph.rev_list(known, tips, tips.select("over", "commit"), spark.createDataFrame([], "commit long, at long")).count() == 0


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_running(spark, size):
    random.seed(4)
    rows = [(random.choice([None, 1, 2]), n, random.choice([None, 3, 5, -2])) for n in range(60)]
    frame = spark.createDataFrame(rows, "k int, pos int, x int").repartition(4)
    got = running(frame, ["k"], "pos", F.floor(F.col("pos") / size), s=("sum", F.col("x")), m=("max", F.col("x")), l=("last", F.col("x")), n=("sum", F.lit(1))).collect()
    for r in got:
        seen = [x for k, p, x in rows if k == r["k"] and p <= r["pos"]]
        known = [x for x in seen if x is not None]
        assert (r["s"], r["m"], r["l"], r["n"]) == (sum(known) if known else None, max(known, default=None), known[-1] if known else None, len(seen))
    assert len(got) == 60
