"""Deep and long pages, and names inside articles."""

import math
import time
import tracemalloc
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from palisade.llm import html


def shown(page):
    return [text for _, text, hidden, _ in html.blocks_of(page) if not hidden]


def test_names_inside_articles():
    page = "<article><h1>h</h1><div class='related-work'><p>a</p></div><section id='comments-on-method'>b</section><div class='comment-list'>x</div><ul class='share-buttons'><li>y</ul><div class='post related-posts'>z</div></article>"
    assert shown(page) == ["h", "a", "b"]
    assert shown("<div class='related-work'>x</div><p>own</p>") == ["own"]


def test_deep_and_unmatched():
    pages = [
        "<div>t" * 150_000,
        "<div class='ads'>t" * 50_000,
        "<span>" * 60_000 + "x</b>" * 60_000,
        "<span>" * 60_000 + "<div>x</div>" * 60_000,
        "<article>" * 60_000 + "x",
    ]
    for page in pages:
        tracemalloc.start()
        began = time.time()
        found = html.blocks_of(page)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert found and peak < 300e6 and time.time() - began < 20
    assert len(html.blocks_of(pages[0])) == 150_000 and len({x[0] for x in html.blocks_of(pages[0])}) == html.DEPTH


def test_deep_pages_whole(spark):
    rows = [(i, "http://deep.org/", "<div>w" * 3000 + f"{i}") for i in range(3)] + [(9, "http://deep.org/", "root <p>x")]
    found = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == {i: "\n".join(["w"] * 2999 + [f"w{i}"]) for i in range(3)} | {9: "root\nx"}


def test_branches_against_plain_entropies(spark):
    """Low branches of random sites, by counting in Python."""
    import random

    r = random.Random(3)
    rows = []
    for page in range(60):
        host = f"h{page % 3}"
        for pos in range(8):
            path = ["b", *(f"{x}{r.randrange(2)}" for x in "cd"[: r.randrange(3)])]
            path = ["/".join(path[: i + 1]) for i in range(len(path))]
            rows.append((host, page, pos, path, r.choice(("same", f"own {page}", "other")) if path[-1].endswith("1") else "same"))
    table = spark.createDataFrame(rows, "host string, page long, pos int, path array<string>, text string")
    doubt, threshold = 2.5, 0.35
    found = html.low_branches(table.select("host", "page", "pos", F.element_at("path", -1).alias("node"), "text"), table.select("host", "path"), doubt, threshold)
    texts, blocks, ways = defaultdict(lambda: defaultdict(set)), defaultdict(Counter), {}
    for host, page, _, path, text in rows:
        texts[host, path[-1]][text].add(page)
        blocks[host, path[-1]][page] += 1
        ways[host, path[-1]] = path
    branches = defaultdict(list)
    for node, by_page in blocks.items():
        m = len(by_page)
        if m < 2:
            continue
        n = [len(x) for x in texts[node].values()]
        content = sum(x * math.log(x) for x in n) / sum(n) / math.log(m)
        shapes = Counter(by_page.values()).values()
        shape = -sum(x / m * math.log(x / m) for x in shapes) / math.log(m)
        own = 1 - (1 - (0.9 * (1 - content) + 0.1 * shape)) * m / (m + doubt)
        for branch in ways[node]:
            branches[node[0], branch].append((own, m))
    wanted = {k for k, x in branches.items() if sum(o * m for o, m in x) / sum(m for _, m in x) < threshold}
    assert {(x["host"], b) for x in found.collect() for b in x["low"]} == wanted and 0 < len(wanted) < len(branches)
