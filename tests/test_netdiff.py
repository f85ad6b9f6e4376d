"""Net diffs of ranges against plain replays of their commits: lines that come and go, text put back, files that come and go, no lines."""

import random

import pytest

from palisade.sources import netdiff


def replay(seed, commits, texts):
    """``(base, states, rows)`` of one path; a line is ``[text]``, itself and no other."""
    random.seed(seed)
    base = [[random.choice(texts)] for _ in range(random.randint(0, 9))]
    cur, rows = list(base), []
    for seq in range(commits):
        gone = [x for x in cur if random.random() < 0.25]
        new = []
        for i, x in enumerate([*cur, None]):
            while random.random() < 0.25:
                new.append([random.choice(texts)])
            if x is not None and not any(x is y for y in gone):
                new.append(x)
        rows += [(seq, "-", i, x[0]) for i, x in enumerate(cur, 1) if any(x is y for y in gone)]
        rows += [(seq, "+", i, x[0]) for i, x in enumerate(new, 1) if not any(x is y for y in cur)]
        cur = new
    return base, cur, rows


def net(base, last, trim):
    """Gap by gap between lines that are in both."""
    out, i, j = [], 0, 0
    while i < len(base) or j < len(last):
        a = b = 0
        while i + a < len(base) and not any(base[i + a] is y for y in last):
            a += 1
        while j + b < len(last) and not any(last[j + b] is y for y in base):
            b += 1
        lo = hi = 0
        if trim:
            while lo < min(a, b) and base[i + lo][0] == last[j + lo][0]:
                lo += 1
            while hi < min(a, b) - lo and base[i + a - 1 - hi][0] == last[j + b - 1 - hi][0]:
                hi += 1
        out += [("-", i + n + 1, base[i + n][0]) for n in range(lo, a - hi)] + [("+", j + n + 1, last[j + n][0]) for n in range(lo, b - hi)]
        i, j = i + a + 1, j + b + 1
    return sorted(out)


@pytest.mark.parametrize(("fan", "block", "trim"), [(16, 4096, True), (2, 3, True), (3, 2, False)])
def test_net_lines(spark, monkeypatch, fan, block, trim):
    monkeypatch.setattr(netdiff, "FAN", fan)
    monkeypatch.setattr(netdiff, "BLOCK", block)
    rows, want = [], {}
    for n in range(24):
        base, last, own = replay(n, [1, 2, 5, 9][n % 4], ["x", "y", "z", ""] if n % 2 else ["only"])
        key, path = n % 5, f"p{n}"
        rows += [(key, seq, 100 * key + seq, path, op, line, text, "clash") for seq, op, line, text in own]
        if left := net(base, last, trim):
            want[key, path] = left
    lines = spark.createDataFrame(rows, "key long, seq int, commit long, path string, op string, line_no int, text string, gap string").repartition(3)
    got = {}
    for r in netdiff.net_lines(lines, trim).collect():
        got.setdefault((r["key"], r["path"]), []).append((r["op"], r["line_no"], r["text"]))
    assert {k: sorted(v) for k, v in got.items()} == want
    assert netdiff.net_lines(lines.limit(0)).collect() == []


def test_net_files(spark):
    lines = spark.createDataFrame([(1, s, 10 + s, p, op, n, t) for s, p, op, n, t in [(0, "new", "+", 1, "a"), (1, "new", "+", 2, "b"), (0, "brief", "+", 1, "c"), (1, "brief", "-", 1, "c"), (0, "old", "-", 1, "d"), (1, "gone", "-", 1, "e"), (0, "back", "-", 2, "f"), (1, "back", "+", 2, "f")]], "key int, seq int, commit int, path string, op string, line_no int, text string")
    files = spark.createDataFrame([(1, s, p, k) for s, p, k in [(0, "new", "added"), (1, "new", "modified"), (0, "brief", "added"), (1, "brief", "deleted"), (0, "old", "modified"), (1, "gone", "deleted"), (0, "back", "modified"), (1, "back", "modified"), (0, "empty", "added")]], "key int, seq int, path string, kind string")
    got = sorted(tuple(r)[1:] for r in netdiff.net_files(netdiff.net_lines(lines), files).collect())
    assert got == [("empty", "added", 0, 0), ("gone", "deleted", 0, 1), ("new", "added", 2, 0), ("old", "modified", 0, 1)]


def test_commits_are_read_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    rows = [(1, s, 10 + s, "p", op, n, f"{op}{n}") for s in range(5) for op in "-+" for n in (1, 4)]
    schema = "key long, seq int, commit long, path string, op string, line_no int, text string"
    lines = spark.createDataFrame(rows, schema).mapInPandas(counted, schema)
    assert netdiff.net_lines(lines).count() == 4
    assert read.value == len(rows)
