"""HTML extraction: a site style tree of each host, without its low-importance branches."""

from __future__ import annotations

import re
from collections import Counter
from hashlib import blake2b
from html.parser import HTMLParser
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.shared import written

#: Fixed values of HTML: elements that never have content or end tags, that start blocks, and that aren't the article's text.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul hr".split())
HIDDEN = set("head script style noscript template iframe object svg math canvas audio video form input button select textarea label nav aside footer dialog menu".split())
CLOSES = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Words in classes, ids and roles of what surrounds an article.
AROUND = re.compile(
    r"(?:^|[^a-z])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|notices?|gdpr|menus?|nav\w*|breadcrumbs?|sidebar|side|aside|footer|comments?|replies|respond|disqus"
    r"|share|sharing|social|related|recommend\w*|newsletter|subscribe|signup|login|search|popup|modal|widget|toolbar|pagination|pager|skip|hidden|complementary|contentinfo|navigation)(?:$|[^a-z])"
)


#: Words that names of such parts hold besides: inside an article a name counts if all its words are of these or those above.
PARTS = set("area bar block body bottom box btn button buttons card cards container content entry feed form group header heading headline holder icons inner item items left links list module outer panel post posts articles stories reader right row section slot title top unit user wrap wrapper".split())
#: Levels of the style tree: what is deeper belongs to its ancestor at the last.
DEPTH = 64


def names_around(style: str, inside: bool) -> bool:
    """Whether class, id and role name what surrounds an article. Inside one, ``related-posts`` does and ``related-work`` doesn't."""
    if not inside or not AROUND.search(style):
        return AROUND.search(style) is not None
    own = lambda word: AROUND.fullmatch(word) is not None
    words = [re.findall("[a-z]+", name) for name in style.split()]
    return any(any(map(own, name)) and all(own(x) or x in PARTS for x in name) for name in words)


class Page(HTMLParser):
    """A page's blocks in order: the style path of the block's element, its text, and whether it may be the article's.

    Time and memory are linear in the page, however deep it is: what is said of all elements around one is kept by a number
    that leads to the one around it, and end tags without an open element aren't looked for.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        # Tag, path, hidden by HTML, in an article or main element, and the innermost element that the word list hides it by.
        self.open: list[tuple[str, tuple[str, ...], bool, bool, int]] = [("", (), False, False, 0)]
        self.blocks: list[tuple[tuple[str, ...], str, bool, bool, int]] = []
        # Places of open elements that are blocks, and how many of each tag are open.
        self.block_at = [0]
        self.count: Counter[str] = Counter()
        # For each element that the word list hides, the one around it, and how many there are up to it.
        self.around, self.level = [0], [0]
        self.holders: dict[str, list[int]] = {"article": [], "main": []}
        self.parts: list[str] = []

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            self.parts = []
            if text:
                self.blocks.append((self.open[self.block_at[-1]][1], text, *self.open[-1][2:]))

    def cut(self, i: int) -> None:
        """Closes the open elements from place ``i`` on."""
        self.count.subtract(x[0] for x in self.open[i:])
        del self.open[i:]
        while self.block_at[-1] >= i:
            self.block_at.pop()

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.parts.append(" ")
            return
        if tag in BLOCK:
            self.flush()
        if tag in VOID:
            return
        if close := CLOSES.get(tag, {"p"} if tag in BLOCK else None):
            # The first of these places is the page itself.
            for i in islice(reversed(self.block_at), len(self.block_at) - 1):
                if self.open[i][0] in close:
                    self.cut(i)
                    break
                if self.open[i][0] != "p":
                    break
        _, path, hidden, main, by = self.open[-1]
        named = {k: v or "" for k, v in attrs}
        style = " ".join(named.get(k, "") for k in ("class", "id", "role")).lower().strip()
        # An article in another one is a comment, by HTML.
        holds = tag in ("html", "body", "main") or (tag == "article" and not self.count["article"])
        around = bool(style) and not holds and names_around(style, main)
        head = tag == "header" and not main
        hidden_now = hidden or tag in HIDDEN or head or "hidden" in named
        if around:
            self.around.append(by)
            self.level.append(self.level[by] + 1)
            by = len(self.around) - 1
        if hidden_now or by:
            self.flush()
        if tag in self.holders and holds and not hidden_now:
            self.holders[tag].append(by)
        if len(path) < DEPTH:
            path = (*path, blake2b(f"{path[-1] if path else ''}/{tag}[{style}]".encode("utf-8", "surrogatepass"), digest_size=12).hexdigest())
        if tag in BLOCK:
            self.block_at.append(len(self.open))
        self.count[tag] += 1
        self.open.append((tag, path, hidden_now, main or (tag in ("article", "main") and not hidden_now), by))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in VOID or not self.count[tag]:
            return
        i = len(self.open) - 1
        while self.open[i][0] != tag:
            i -= 1
        if self.block_at[-1] >= i or self.open[i][2] != self.open[i - 1][2] or self.open[i][4] != self.open[i - 1][4]:
            self.flush()
        self.cut(i)

    def handle_data(self, data):
        self.parts.append(data)

    def done(self) -> list[tuple[tuple[str, ...], str, bool, bool]]:
        self.close()
        self.flush()
        # Elements around the outermost articles, and around the outermost main, aren't hidden by their names.
        spared = {0}
        for found in self.holders.values():
            least = min((self.level[by] for by in found), default=0)
            for by in found:
                if self.level[by] == least:
                    while by not in spared:
                        spared.add(by)
                        by = self.around[by]
        shown = [True]
        for i in range(1, len(self.around)):
            shown.append(i in spared and shown[self.around[i]])
        return [(path, text, hidden or not shown[by], main) for path, text, hidden, main, by in self.blocks]


def blocks_of(html: str | None) -> list[tuple[tuple[str, ...], str, bool, bool]]:
    page = Page()
    page.feed(html or "")
    return page.done()


PARSED = "paths array<array<string>>, blocks array<struct<node:int,text:string,hidden:boolean,main:boolean>>"


def parsed(pages: DataFrame) -> DataFrame:
    """``pages`` without ``html``, with ``host``, ``paths`` (each path once: its elements' ids, from the outermost) and ``blocks``, whose ``node`` is a path's place from 0."""

    @F.pandas_udf(PARSED)
    def parse(html: pd.Series) -> pd.DataFrame:
        paths, blocks = [], []
        for page in html:
            place: dict[tuple[str, ...], int] = {}
            blocks.append([{"node": place.setdefault(path, len(place)), "text": text, "hidden": hidden, "main": main} for path, text, hidden, main in blocks_of(page)])
            paths.append([list(x) for x in place])
        return pd.DataFrame({"paths": pd.Series(paths, dtype=object), "blocks": pd.Series(blocks, dtype=object)})

    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    found = pages.withColumns({"host": host, "_parsed": parse(F.col("html").cast("string"))})
    return found.withColumns({"paths": F.col("_parsed.paths"), "blocks": F.col("_parsed.blocks")}).drop("html", "_parsed")


def low_branches(blocks: DataFrame, paths: DataFrame, doubt: float, threshold: float) -> DataFrame:
    """``host, low``: the elements of each host's tree that its pages' blocks are not to be taken from, of ``blocks(host, page, pos, node, text)`` and ``paths(host, path)``.

    Content importance of a node is 1 minus the mean entropy of its texts over the host's pages, to the base
    of the number of pages: 0 if all have one text, 1 if none share any. Presentation importance is the
    entropy of how many blocks the node has. What speaks against a node weighs the less the fewer pages have it: of ``m``
    pages, m to m + ``doubt``. A branch's importance is the mean of its nodes', by pages.
    """
    each = blocks.groupBy("host", "node", F.xxhash64("text").alias("t"), "page").agg(F.size(F.collect_set("pos")).alias("k"))
    texts = each.groupBy("host", "node", "t").agg(F.count("*").alias("n"))
    shapes = each.groupBy("host", "node", "page").agg(F.sum("k").alias("k")).groupBy("host", "node", "k").agg(F.count("*").alias("n"))
    pages = shapes.groupBy("host", "node").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("e"))
    content = texts.groupBy("host", "node").agg((F.sum(F.col("n") * F.log("n")) / F.sum("n")).alias("h"))
    nodes = pages.join(content, ["host", "node"]).where("m > 1")
    log_m = F.log("m")
    shape = (log_m - F.col("e") / F.col("m")) / log_m
    own = 0.9 * (1 - F.col("h") / log_m) + 0.1 * shape
    nodes = nodes.select("host", "node", "m", (1 - (1 - own) * F.col("m") / (F.col("m") + doubt)).alias("own"))
    ways = paths.where(F.size("path") > 0).distinct().select("host", F.element_at("path", -1).alias("node"), "path")
    branches = nodes.join(ways, ["host", "node"]).select("host", "m", "own", F.explode("path").alias("branch"))
    low = branches.groupBy("host", "branch").agg((F.sum(F.col("own") * F.col("m")) / F.sum("m")).alias("importance"))
    return low.where(F.col("importance") < threshold).groupBy("host").agg(F.collect_set("branch").alias("low"))


def extract(pages: DataFrame, doubt: float = 2.5, threshold: float = 0.2) -> DataFrame:
    """``pages`` without ``html``, with ``text``: the article's blocks in page order, one to a line.

    Same-host pages are merged into a tree of style paths (tags with class, id and role). What HTML or a class
    says is a menu, header, footer, sidebar, notice, advert, form, script or comment is left out; so are
    branches of less importance than ``threshold``, for which pages that all have one text must be more than 4 * ``doubt``.
    The tree has ``DEPTH`` levels; pages of any size and depth take time and memory in proportion. Names hide no html, body, main or article element, nor one around the page's outermost articles or main; an
    article inside an article may be a comment. If the page has an article or main element, only blocks inside count. References are decoded, white space
    inside a block is one space; ``br`` is white space. Null or empty html, and pages without an article, give
    an empty text. Pages of a host whose blocks outside these are equal count as one; rows without url share a host without name.
    Other columns stay; columns called ``text``, ``host``, ``paths``, ``blocks`` or ``low`` are replaced.
    """
    pages = pages.drop("text", "host", "paths", "blocks", "low", "_parsed", "_under", "_page").withColumn("_page", F.monotonically_increasing_id())
    found = written(parsed(pages), "blocks")
    # Copies of a page say nothing of the template: each content, but for what is hidden, is one page of its host.
    named = lambda b: F.struct(F.try_element_at(F.get("paths", b["node"]), F.lit(-1)).alias("node"), b["text"].alias("text"), b["main"].alias("main"))
    own = F.transform(F.filter("blocks", lambda b: ~b["hidden"]), named)
    rows = found.select("host", F.xxhash64(own).alias("page"), F.posexplode(own).alias("pos", "b")).select("host", "page", "pos", "b.node", "b.text")
    paths = found.select("host", F.explode("paths").alias("path"))
    low = written(low_branches(rows.where("node is not null"), paths, doubt, threshold), "low")
    # Small unless templates are many: Spark then sends it to all executors, and otherwise splits large hosts.
    joined = found.join(low, "host", "left")
    shown = F.filter("blocks", lambda b: ~b["hidden"])
    shown = F.when(F.exists(shown, lambda b: b["main"]), F.filter(shown, lambda b: b["main"])).otherwise(shown)
    # Whether each path leads through a low branch is found once, not for each block.
    joined = joined.withColumn("_under", F.transform("paths", lambda p: F.arrays_overlap(p, F.coalesce("low", F.array().cast("array<string>")))))
    kept = F.filter(shown, lambda b: ~F.get("_under", b["node"]))
    text = F.array_join(F.transform(kept, lambda b: b["text"]), "\n")
    return joined.withColumn("text", F.coalesce(text, F.lit(""))).drop("host", "paths", "blocks", "low", "_under", "_page")
