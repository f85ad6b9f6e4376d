"""Patches of many lines: read in runs of any length they give what they give in one."""

import random

from palisade.sources.patches import patch_files, patch_lines


def piece(r: random.Random, i: int) -> list[str]:
    """A file's part of a patch, with text that looks like headers, hunks that end early, and headers without partners."""
    kind = r.randrange(6)
    if kind == 0:
        return [f"Binary files a/p{i} and b/p{i} differ"]
    if kind == 1:
        return [f"--- a/lost{i}", "index 1..2"] if i % 2 else [f"+++ b/lost{i}"]
    old, new = ("/dev/null" if kind == 2 else f"a/p{i}"), ("/dev/null" if kind == 3 else f"b/p{i}\t")
    out = [f"diff --git a/p{i} b/p{i}", f"--- {old}", f"+++ {new}"]
    for k in range(r.randrange(4)):
        body = [r.choice("+-") + r.choice(("x", "++ b/no", "-- a/no", "@@ -1 +1 @@")) if r.random() < 0.8 else " ctx" for _ in range(r.randrange(1, 9))]
        minus, plus = sum(x[0] != "+" for x in body), sum(x[0] != "-" for x in body)
        out += [f"@@ -{10 * k + 1},{minus} +{10 * k + 2},{plus} @@ f", *body] + (["\\ No newline at end of file"] if r.random() < 0.3 else [])
    return out


def plain(lines: list[str]) -> tuple[list, list]:
    """The same line by line: added and removed lines, and files with their counts."""
    old = at = None
    left, place, found, files = [0, 0], [0, 0], [], []
    for x in lines:
        sign = x[:1]
        if x.startswith("@@ -"):
            a, b = (y[1:].split(",") for y in x.split(" ")[1:3])
            place, left = [int(a[0]), int(b[0])], [int(a[1]), int(b[1])]
            continue
        uses = {" ": (1, 1), "-": (1, 0), "+": (0, 1)}.get(sign)
        if uses and all(have >= use for have, use in zip(left, uses, strict=True)) and any(left):
            if sign != " ":
                found.append((at, sign, place[sign == "+"], x[1:]))
                files[-1][1 + (sign == "-")] += 1
            left, place = [h - u for h, u in zip(left, uses, strict=True)], [p + u for p, u in zip(place, uses, strict=True)]
            continue
        if x.startswith("--- "):
            old = x[4:].rstrip("\t")
        elif x.startswith("+++ "):
            if old is not None:
                new = x[4:].rstrip("\t")
                at = (new if new != "/dev/null" else old)[2:]
                files.append([at, 0, 0])
            old = None
        elif x.startswith("Binary"):
            at = x.split(" and b/")[1].removesuffix(" differ")
            files.append([at, 0, 0])
    return found, files


def test_runs_of_any_length(spark):
    r = random.Random(5)
    texts = {k: [x for i in range(12) for x in piece(r, i)] for k in range(5)}
    rows = [(k, "\n".join(x)) for k, x in texts.items()] + [(None, "\n".join(texts[0])), (7, ""), (8, None)]
    whole = spark.createDataFrame(rows, "id long, text string")
    numbered = spark.createDataFrame([(k, i, x) for k, xs in {**texts, None: texts[0]}.items() for i, x in enumerate(xs)], "id long, pos long, raw string").repartition(3)
    key = lambda x: tuple((y is None, y) for y in x)
    lines = sorted(((k, *x) for k, xs in {**texts, None: texts[0]}.items() for x in plain(xs)[0]), key=key)
    files = sorted(((k, n + 1, *x) for k, xs in {**texts, None: texts[0]}.items() for n, x in enumerate(plain(xs)[1])), key=key)
    for patches, block in ((whole, None), (whole, 3), (numbered, 4)):
        assert sorted(map(tuple, patch_lines(patches, "id", block=block).collect()), key=key) == lines
        found = patch_files(patches, "id", block=block).select("id", "file_ord", "path", "added", "removed")
        assert sorted(map(tuple, found.collect()), key=key) == files


def test_one_long_patch_is_many_tasks_work(spark):
    n = 60_000
    rows = spark.range(n + 3).selectExpr("1L AS id", "id AS pos", f"CASE id WHEN 0 THEN '--- a/x' WHEN 1 THEN '+++ b/x' WHEN 2 THEN '@@ -0,0 +1,{n} @@' ELSE concat('+', id - 2) END AS raw")
    found = patch_lines(rows, "id", block=1000)
    assert found.where("path = 'x' AND text = line_no").count() == found.count() == n
