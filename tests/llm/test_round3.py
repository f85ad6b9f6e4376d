"""Merkle manifest, ranked search and near-duplicate embeddings against brute force, with nulls, empty and long texts, ties, repeated rows, no rows and clashing columns."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from palisade.llm import lattice, merkle, treap

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, hash string, place long, proof string, key long, root string"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in FIELDS))


def tree(hashes):
    """All levels, leaves first."""
    levels = [list(hashes)]
    while len(levels[-1]) > 1:
        own = levels[-1]
        levels.append([sha("".join(own[i : i + 2])) for i in range(0, len(own), 2)])
    return levels


def path(levels, at):
    out = []
    for level in levels[:-1]:
        out.append((at ^ 1) & 1 and level[at ^ 1 : (at ^ 1) + 1] and (1, level[at ^ 1]) or (level[at ^ 1 : (at ^ 1) + 1] and (0, level[at ^ 1]) or None))
        at >>= 1
    return out


def climb(h, steps):
    for x in steps:
        h = sha(h) if x is None else sha(h + x[1]) if x[0] else sha(x[1] + h)
    return h


def brute(rows):
    """By row: leaf, subroot, root, proof, and the siblings."""
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        trees[name] = tree([leaf(r) for r in groups[name]])
    top = tree([trees[n][-1][0] for n in names])
    out = []
    for i, name in enumerate(names):
        for j, r in enumerate(groups[name]):
            steps = path(trees[name], j) + path(top, i)
            out.append((r, leaf(r), trees[name][-1][0], top[-1][0], sha("".join(x[1] for x in steps if x)), steps))
    return out


def merkle_rows():
    random.seed(3)
    rows = [dict(doc_id=i, text=f"text {i} é" if i % 11 else None, lang=random.choice(["en", "de", "é", "z"]), source="s" if i % 5 else None, n_chars=i if i % 3 else None) for i in range(211)]
    rows += [dict(doc_id=900, text="", lang=None, source="", n_chars=0), dict(doc_id=None, text="x" * 100_000, lang="en", source="s", n_chars=1), dict(doc_id=None, text="y", lang="en", source="s", n_chars=1)]
    return rows + rows[:4]


def frame(spark, rows):
    return spark.createDataFrame([(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], "t", "h", 1, "p", 5, "r") for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("band", [2, 10])
def test_merkle(spark, monkeypatch, band):
    monkeypatch.setattr(merkle, "BAND", band)
    rows = merkle_rows()
    more = {"n_chars": F.when(F.col("doc_id") % 4 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
    got = merkle.verified(frame(spark, rows), FIELDS, "lang", "doc_id", more).collect()
    want = []
    for r, h, subroot, root, proof, steps in brute(rows):
        claimed = r | {"n_chars": r["n_chars"] + 1} if r["doc_id"] is not None and r["doc_id"] % 4 == 0 and r["n_chars"] is not None else r
        end = climb(leaf(claimed), steps)
        assert (end == root) == (claimed == r)
        want.append((r["doc_id"], h, subroot, root, proof, end, end == root))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


@pytest.mark.parametrize("band", [2, 10])
def test_merkle_of_some_leaves(spark, monkeypatch, band):
    monkeypatch.setattr(merkle, "BAND", band)
    rows = merkle_rows()[:200]
    manifest = merkle.manifest_of(frame(spark, rows), FIELDS, "lang", "doc_id")
    got = {r["key"]: r for r in merkle.prove(manifest, F.col("key") % 17 == 3).collect()}
    assert sorted(got) == [r["doc_id"] for r in rows if r["doc_id"] % 17 == 3]
    for r, h, subroot, root, proof, steps in brute(rows):
        if r["doc_id"] in got:
            own = got[r["doc_id"]]
            assert (own["hash"], own["subroot"], own["root"], own["proof_sha256"], own["folded_root"]) == (h, subroot, root, proof, root)
            assert own["proof"] == ",".join("<>"[x[0]] + x[1] for x in steps if x)
    assert manifest.root.first()[0] == brute(rows)[0][3]


def test_merkle_of_one_and_none(spark):
    rows = merkle_rows()[:1]
    got = merkle.verified(frame(spark, rows), FIELDS, "lang", "doc_id").collect()
    h = leaf(rows[0])
    assert [tuple(r) for r in got] == [(0, h, h, h, sha(""), h, True)]
    assert merkle.verified(frame(spark, []), FIELDS, "lang", "doc_id").collect() == []


def test_fewest_missing_nodes():
    """No node that is named follows from the leaves or the others that are named."""
    random.seed(1)
    for n in (1, 2, 3, 7, 8, 21, 64):
        places = sorted(random.sample(range(n), random.randint(1, n)))
        levels = tree([sha(str(i)) for i in range(n)])
        need = merkle.missing(np.array(places), n)
        known = {(0, p): levels[0][p] for p in places}
        full = merkle.interiors(known | {x: levels[x[0]][x[1]] for x in need}, n)
        assert full[len(levels) - 1, 0] == levels[-1][0]
        for x in need:
            assert (len(levels) - 1, 0) not in merkle.interiors(known | {y: levels[y[0]][y[1]] for y in need if y != x}, n)


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = {i: i + 32 for i in range(65, 91)}


def ranked(docs, items, k):
    words = [(i, Counter(TERM.findall((t or "").translate(LOW)))) for i, t in docs]
    words = [(i, c, sum(c.values())) for i, c in words if c]
    n, total = len(words), sum(x[2] for x in words)
    df = Counter(w for _, c, _ in words for w in c)
    out = []
    for item, texts in items.items():
        asked = {w for t in texts for w in TERM.findall((t or "").translate(LOW))}
        scores = []
        for i, c, size in words:
            m = 50 + (50 * size * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 20 * m)) for w in asked if w in c)
            if s > 0 and i is not None:
                scores.append((-s, i))
        out += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize(("shard", "beam", "asked"), [(8192, 256, 200_000), (37, 1, 20), (1, 3, 5)])
def test_ranked_search(spark, monkeypatch, shard, beam, asked):
    monkeypatch.setattr(treap, "DOCUMENTS", shard)
    monkeypatch.setattr(treap, "BEAM", beam)
    monkeypatch.setattr(treap, "TOGETHER", 2)
    random.seed(9)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "é", "日本", "x1_y2", "KK", "a b"]
    text = lambda n: " ".join(random.choices(vocabulary, weights=[1 / (i + 1) for i in range(len(vocabulary))], k=n))
    docs = [(i, text(random.randint(1, 40)).upper() if i % 7 == 0 else text(random.randint(1, 40))) for i in range(150)]
    docs += [(200, None), (201, ""), (202, " ,.;"), (203, text(20_000)), (None, text(30)), (204, docs[3][1]), (3, docs[3][1]), (5, "w1 w1 w2")]
    items = [(i, text(6)) for i in range(9)] + [(20, None), (21, "nowhere"), (22, ""), (23, docs[3][1]), (24, "w1 W1 w1"), (None, "w1"), (3, "w9 w10"), (23, docs[3][1])]
    rows = spark.createDataFrame([(i, t, 1, "w") for i, t in docs], "doc_id long, text string, rank int, words string").repartition(3)
    wanted = spark.createDataFrame([(i, t, 0, 2) for i, t in items], "item_id long, text string, doc_id long, score long")
    by = {}
    for i, t in items:
        if i is not None:
            by.setdefault(i, []).append(t)
    for k in (5, 300):
        got = sorted(tuple(r) for r in treap.search(wanted, rows, k, asked).collect())
        assert got == ranked(docs, by, k)
    assert treap.search(wanted, rows.limit(0)).collect() == [] and treap.search(wanted.limit(0), rows).collect() == []


def test_treap_keeps_each_cell_once():
    random.seed(4)
    cells = {(random.randrange(50), random.randrange(90)): random.randrange(1, 30) for _ in range(700)}
    row, col = np.array(list(cells)).T
    grown = treap.grow(row, col, np.array(list(cells.values())), 7)
    back = treap.Treap(*(grown[k].tobytes() for k in ("gap", "spot", "kids", "levels")), 7)
    assert {(r, c): v for r, c, v in zip(back.row.tolist(), back.col.tolist(), back.value.tolist(), strict=True)} == cells and len(back.row) == len(cells)


def neighbours(rows, least):
    """``(n_links, component)`` by place, over all pairs."""
    good = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) and label is not None and i is not None for i, v, label in rows]
    unit = [np.array(v, float) / np.abs(v).max() if g else None for (_, v, _), g in zip(rows, good, strict=True)]
    unit = [None if u is None else u / np.linalg.norm(u) for u in unit]
    links = [[j for j in range(len(rows)) if j != i and good[i] and good[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least] for i in range(len(rows))]
    low = [r[0] for r in rows]
    for _ in rows:
        low = [min([low[i], *(low[j] for j in links[i])]) if links[i] else low[i] for i in range(len(rows))]
    return [(len(x), c) for x, c in zip(links, low, strict=True)]


@pytest.mark.parametrize(("tile", "lattices", "tables"), [(256, 1, 4), (3, 1, 4), (5, 2, 12)])
def test_near_duplicates(spark, tile, lattices, tables):
    random_ = np.random.default_rng(2)
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(random_.standard_normal((90, 16)))]
    centre = random_.standard_normal(16)
    rows += [(100 + i, (centre + 0.02 * random_.standard_normal(16)).tolist(), 1) for i in range(40)]
    rows += [(200 + i, rows[5][1], 2) for i in range(6)] + [(300, [2 * x for x in rows[5][1]], 2), (301, rows[5][1], 1), (302, rows[5][1], None)]
    rows += [(400, None, 1), (401, [], 1), (402, [0.0] * 16, 1), (403, [math.nan] * 16, 1), (404, [1.0, None], 1), (405, [math.inf] + [0.0] * 15, 1), (406, [1.0, 0.0], 1), (407, [1.0, 1e-9], 1)]
    rows += [(408, [1e300, -1e300], 2), (409, [1e-300, -1e-300], 2), (100, rows[90][1], 1), (None, rows[90][1], 1)]
    frame = spark.createDataFrame([(i, v, label, 1, 2, False) for i, v, label in rows], "vec_id long, embedding array<double>, label int, n_links int, cls long, kept boolean").repartition(3)
    got = lattice.near_duplicates(frame, 0.98, tables, 3, lattices, tile=tile).collect()
    want = [(i, n, c, i is not None and i == c) for (i, _, _), (n, c) in zip(rows, neighbours(rows, 0.98), strict=True)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert lattice.near_duplicates(frame.limit(0)).collect() == []


def test_pairs_at_the_least_cosine_share_cells():
    random_ = np.random.default_rng(5)
    x, y = random_.standard_normal((2, 4000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y -= (x * y).sum(axis=1)[:, None] * x
    y = 0.98 * x + math.sqrt(1 - 0.98**2) * y / np.linalg.norm(y, axis=1)[:, None]
    coder = lattice.Tables(0.98, 4, 3, 1, 7)
    p, q = coder.cells(x), coder.cells(y)
    met = ((p[:, :, :1] == q) | (q[:, :, :1] == p)).any(axis=(1, 2))
    assert met.mean() > 0.995


def test_lattice_points_are_nearest():
    random_ = np.random.default_rng(6)
    x = 2 * random_.standard_normal((500, 8))
    home = lattice.nearest_e8(x)
    assert ((home * 2) % 1 == 0).all() and (home.sum(axis=1) % 2 == 0).all()
    gaps = ((x[:, None] - home[:, None] - lattice.NEAREST[None]) ** 2).sum(axis=2)
    assert (((x - home) ** 2).sum(axis=1)[:, None] <= gaps + 1e-12).all() and len(np.unique(lattice.NEAREST, axis=0)) == 240


def test_exact_search_with_outliers(spark):
    """Components of any size have a defined floor; only a score that is returned and no long is an error."""
    from palisade.llm import exact_search

    random.seed(1)
    rows = [(i, [random.uniform(-3, 3) for _ in range(6)]) for i in range(40)] + [(50, [1e300, *[0.0] * 5]), (51, [-1e300, *[0.0] * 5]), (52, [2.0**45, 0.5, *[0.0] * 4])]
    queries = [(0, [0.0, 1.0, 2.0, -1.0, 0.5, 0.1]), (52, rows[42][1]), (7, rows[7][1])]
    floor = lambda v: [math.floor(1024 * x) if abs(x) < 2.0**43 else int(1024 * x) for x in v]
    def brute(some, asked, k):
        out = []
        for q, v in asked:
            scores = sorted((-sum(a * b for a, b in zip(floor(v), floor(w), strict=True)), i) for i, w in some if i != q)[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(scores, 1)]
        return sorted(out)
    frame = lambda x: spark.createDataFrame(x, "vec_id long, embedding array<double>").repartition(3)
    # The first component of the first query is 0, so outliers' scores stay small.
    some, asked = rows[:41], queries[:1]
    assert sorted(tuple(r) for r in exact_search.top_k(frame(some), frame(asked), 5, stripe_rows=9).collect()) == brute(some, asked, 5)
    some = [r for r in rows if r[0] != 50]
    low = [(99, [1.0, *[0.0] * 5]), (0, queries[0][1])]
    assert sorted(tuple(r) for r in exact_search.top_k(frame([r for r in some if r[0] != 52]), frame(low), 5, stripe_rows=1000).collect()) == brute([r for r in some if r[0] != 52], low, 5)
    with pytest.raises(Exception, match="range of a long"):
        exact_search.top_k(frame(rows), frame([(99, [1.0, *[0.0] * 5])]), 5).collect()
    with pytest.raises(Exception, match="range of a long"):
        exact_search.top_k(frame(rows[41:42]), frame([(99, [1.0, *[0.0] * 5])]), 5).collect()
