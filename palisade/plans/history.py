"""Registered queries over commit graphs and over what whole ranges change, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palisade.operators import engine
from palisade.plans.registry import query
from palisade.sources import adapters as A
from palisade.sources import graph, netdiff, patches, policies
from palisade.sources.tables import settled, swept

#: Orders as commits: 500 to a repository. Of seven, the fourth and fifth are a side branch from the second; the sixth merges it in every other
#: group and is plain in the others, which leave it a head of its own; in each fifth group it has no parent, a root of its own. Every 13th clock is three hours slow.
COMMIT = {
    "commit": "o_orderkey",
    "repo": "o_orderkey DIV 500",
    "p1": "CASE WHEN o_orderkey % 7 = 3 AND (o_orderkey DIV 7) % 5 = 4 THEN NULL WHEN o_orderkey % 7 = 3 THEN o_orderkey - 2 WHEN o_orderkey % 7 = 5 THEN o_orderkey - 3 ELSE o_orderkey - 1 END",
    "p2": "CASE WHEN o_orderkey % 7 = 5 AND (o_orderkey DIV 7) % 2 = 0 THEN o_orderkey - 1 END",
    "at": "1600000000 + 60 * o_orderkey - CASE WHEN o_orderkey % 13 = 0 THEN 10800 ELSE 0 END",
}
ROWS_SQL = f"""raw AS (SELECT {", ".join(f"{v.replace('DIV', '//')} AS {k}" for k, v in COMMIT.items())} FROM orders),
    commits AS (SELECT "commit", repo, CASE WHEN p1 // 500 = repo AND p1 >= 0 THEN p1 END AS p1, CASE WHEN p2 // 500 = repo THEN p2 END AS p2, "at" FROM raw),
    parents AS (SELECT "commit" AS child, p1 AS parent FROM commits WHERE p1 IS NOT NULL UNION ALL SELECT "commit", p2 FROM commits WHERE p2 IS NOT NULL)"""
#: Dates by repository, commit after commit: what three commits back and less has, since no parent is farther.
DATES_SQL = """lifted AS (SELECT repo, "commit" AS c, "at" AS d0, CAST(NULL AS BIGINT) AS d1, CAST(NULL AS BIGINT) AS d2 FROM commits WHERE "commit" % 500 = 0
    UNION ALL SELECT r.repo, g."commit", greatest(g."at", coalesce(1 + CASE g."commit" - g.p1 WHEN 1 THEN d0 WHEN 2 THEN d1 WHEN 3 THEN d2 END, g."at"), coalesce(1 + d0 + 0 * g.p2, g."at")), d0, d1
    FROM lifted r JOIN commits g ON g."commit" = r.c + 1 AND g.repo = r.repo), dates AS (SELECT c AS "commit", d0 AS "at" FROM lifted)"""
LISTED_SQL = """walked AS (SELECT DISTINCT key, "commit", out FROM tips UNION SELECT w.key, p.parent, w.out FROM walked w JOIN parents p ON p.child = w."commit"),
    listed AS (SELECT w.key, w."commit", d."at" FROM walked w JOIN commits c ON c."commit" = w."commit" JOIN dates d ON d."commit" = w."commit" WHERE NOT w.out AND (c.p1 IS NULL OR c.p2 IS NULL)
               AND NOT EXISTS (SELECT 1 FROM walked o WHERE o.out AND o.key = w.key AND o."commit" = w."commit"))"""


def commits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = A.read(spark, sf_dir, "orders").selectExpr(*[f"{v} AS {k}" for k, v in COMMIT.items()])
    inside = lambda c: F.when((F.floor(F.col(c) / 500) == F.col("repo")) & (F.col(c) >= 0), F.col(c))
    each = F.array(F.struct(F.lit(0).alias("ord"), inside("p1").alias("parent")), F.struct(F.lit(1).alias("ord"), inside("p2").alias("parent")))
    parents = rows.select(F.col("commit").alias("child"), F.inline(each)).where("parent is not null")
    return rows.select("commit", "repo", "at"), parents


#: Of each repository, what is between the heads of its main line's commits 70 and 430, and 435 and the side branch ending at 428.
RANGES_SQL = """tips AS (SELECT 'r' || CAST(repo AS VARCHAR) || x.name AS key, 500 * repo + x.n AS "commit", x.out FROM (SELECT DISTINCT repo FROM commits) r,
    (VALUES ('/long', 430, false), ('/long', 70, true), ('/side', 435, false), ('/side', 428, true)) x(name, n, out) WHERE 500 * repo + x.n IN (SELECT "commit" FROM commits))"""


@query("rev_list", f"""WITH RECURSIVE {ROWS_SQL}, {DATES_SQL}, {RANGES_SQL}, {LISTED_SQL}
    SELECT key, row_number() OVER (PARTITION BY key ORDER BY "at", "commit") AS ordinal, "commit" FROM listed""")  # fmt: skip
def rev_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ranges of each repository, oldest first, without merges."""
    rows, parents = commits(spark, sf_dir)
    known = graph.chained(rows, parents)
    named = F.concat(F.lit("r"), F.col("repo").cast("string"))
    ends = F.inline(F.array(*[F.struct(F.concat(named, F.lit(n)).alias("key"), (500 * F.col("repo") + b).alias("b"), (500 * F.col("repo") + a).alias("a")) for n, b, a in (("/long", 430, 70), ("/side", 435, 428))]))
    ranges = rows.select("repo").distinct().select(ends)
    wants, unwanted = ranges.select("key", F.col("key").alias("over"), F.col("b").alias("commit")), ranges.select(F.col("key").alias("over"), F.col("a").alias("commit"))
    return graph.rev_list(known, wants, unwanted, graph.corrected(known, rows))


#: Local heads of each repository: its main line's last commits, and side branches that no merge took in; remote heads are the main line's up to the 400th.
REFS_SQL = """locals AS (SELECT 'r' || CAST(repo AS VARCHAR) || CASE "commit" % 7 WHEN 4 THEN '/side' ELSE '/main' END || CAST("commit" AS VARCHAR) AS key, repo, "commit" FROM commits WHERE ("commit" % 7 = 4 AND ("commit" // 7) % 2 = 1 AND "commit" % 500 > 450) OR "commit" % 500 = 497),
    tips AS (SELECT key, "commit", false AS out FROM locals UNION ALL SELECT l.key, c."commit", true FROM locals l JOIN commits c ON c.repo = l.repo AND c."commit" % 100 = 6 AND c."commit" % 500 <= 406)"""


def pushed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, parents = commits(spark, sf_dir)
    known = graph.chained(rows, parents)
    c = F.col("commit")
    side = (c % 7 == 4) & (F.floor(c / 7) % 2 == 1) & (c % 500 > 450)
    name = F.concat(F.lit("r"), F.col("repo").cast("string"), F.when(c % 7 == 4, "/side").otherwise("/main"), c.cast("string"))
    wants = rows.where(side | (c % 500 == 497)).select(name.alias("key"), F.col("repo").alias("over"), "commit")
    remote = rows.where((c % 100 == 6) & (c % 500 <= 406)).select(F.col("repo").alias("over"), "commit")
    return graph.rev_list(known, wants, remote, graph.corrected(known, rows))


@query("unpushed_refs", f"""WITH RECURSIVE {ROWS_SQL}, {DATES_SQL}, {REFS_SQL}, {LISTED_SQL}
    SELECT key, row_number() OVER (PARTITION BY key ORDER BY "at", "commit") AS ordinal, "commit" FROM listed""")  # fmt: skip
def unpushed_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each local head has that no remote head of its repository has."""
    return pushed(spark, sf_dir)


@query("unverified_refs", f"""WITH RECURSIVE {ROWS_SQL}, {DATES_SQL}, {REFS_SQL}, {LISTED_SQL} SELECT key, count(*) AS n_unverified, min("commit") AS first_commit FROM listed WHERE "commit" % 3 = 0 GROUP BY 1""")
def unverified_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the check before a push refuses: of each head's new commits those whose tree no passed check has marked."""
    trees = A.changes(spark, sf_dir).select(F.col("change_id").alias("commit"), "tree_hash", F.lit(False).alias("is_merge"))
    bad = engine.unverified(pushed(spark, sf_dir).join(trees, "commit"), A.markers(spark, sf_dir))
    return bad.groupBy("key").agg(F.count("*").alias("n_unverified"), F.min("commit").alias("first_commit"))


#: Lines of documents as lines of files with a life: those of version 0 stand in the base, others come with a commit, and some go with a later one. 50 files make a range of four commits.
LIFE = {"born": "CASE WHEN (31 * doc_id + 7 * p) % 12 < 6 THEN 0 ELSE (31 * doc_id + 7 * p) % 12 DIV 2 - 2 END", "dies": "CASE (17 * doc_id + 5 * p) % 9 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 4 ELSE 99 END"}
LIVES_SQL = f"""lives AS (SELECT doc_id, doc_id // 50 AS range_id, p, raw, born, CASE WHEN dies > born THEN dies ELSE 99 END AS dies FROM (SELECT doc_id, p, raw, {", ".join(f"{v.replace('DIV', '//')} AS {k}" for k, v in LIFE.items())}
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS p FROM documents)))"""
#: What is left of removed and added lines once the ends of a gap that agree are taken away.
NET_SQL = f"""{LIVES_SQL}, ends AS (SELECT *, count(*) FILTER (born = 0) OVER w AS old, count(*) FILTER (born <= 4 AND dies > 4) OVER w AS new, coalesce(max(CASE WHEN born = 0 AND dies > 4 THEN p END) OVER w, -1) AS gap
        FROM lives WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
    net AS (SELECT range_id, doc_id, '-' AS op, old AS line_no, raw, gap FROM ends WHERE born = 0 AND dies <= 4 UNION ALL SELECT range_id, doc_id, '+', new, raw, gap FROM ends WHERE born BETWEEN 1 AND 4 AND dies > 4),
    f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, gap, op ORDER BY line_no) AS k FROM net),
    fs AS (SELECT a.doc_id, a.gap, a.k, max(CASE WHEN a.raw = b.raw THEN 0 ELSE 1 END) OVER (PARTITION BY a.doc_id, a.gap ORDER BY a.k) AS off FROM f a JOIN f b USING (doc_id, gap, k) WHERE a.op = '-' AND b.op = '+'),
    g AS (SELECT f.* EXCLUDE k, row_number() OVER (PARTITION BY doc_id, gap, op ORDER BY line_no DESC) AS k FROM f WHERE NOT EXISTS (SELECT 1 FROM fs WHERE off = 0 AND fs.doc_id = f.doc_id AND fs.gap = f.gap AND fs.k = f.k)),
    gs AS (SELECT a.doc_id, a.gap, a.k, max(CASE WHEN a.raw = b.raw THEN 0 ELSE 1 END) OVER (PARTITION BY a.doc_id, a.gap ORDER BY a.k) AS off FROM g a JOIN g b USING (doc_id, gap, k) WHERE a.op = '-' AND b.op = '+'),
    left_over AS (SELECT * FROM g WHERE NOT EXISTS (SELECT 1 FROM gs WHERE off = 0 AND gs.doc_id = g.doc_id AND gs.gap = g.gap AND gs.k = g.k))"""


def range_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(range_id, seq, text)``: the patches of each range's four commits."""
    rows = A.read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("p", "raw")).selectExpr("doc_id", "p", "raw", *[f"{v} AS {k}" for k, v in LIFE.items()])
    rows = rows.withColumn("dies", F.when(F.col("dies") > F.col("born"), F.col("dies")).otherwise(99))
    so_far = Window.partitionBy("doc_id").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    alive = lambda v: ((F.col("born") <= v) & (F.col("dies") > v)).cast("int")
    rows = rows.withColumns({f"n{v}": F.sum(alive(v)).over(so_far) for v in range(5)})
    hunk = lambda old, new, sign: F.concat(F.lit("@@ -"), F.col("old").cast("string"), F.lit(f",{old} +"), F.col("new").cast("string"), F.lit(f",{new} @@\n{sign}"), "raw")
    # What each commit does to a line, if anything.
    step = [F.when((F.col("dies") == v) | (F.col("born") == v), F.struct(F.lit(v).alias("seq"), F.col(f"n{v - 1}").alias("old"), F.col(f"n{v}").alias("new"))) for v in range(1, 5)]
    rows = rows.withColumn("s", F.explode(F.array_compact(F.array(*step)))).select("doc_id", "p", "raw", "born", "dies", "s.*")
    text = F.when(F.col("dies") == F.col("seq"), hunk(1, 0, "-")).when(F.col("born") == F.col("seq"), hunk(0, 1, "+"))
    path = F.concat(F.lit("src/doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    one = rows.withColumn("hunk", text).where("hunk is not null").groupBy("doc_id", "seq").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p", "hunk"))), lambda x: x["hunk"]), "\n").alias("hunks"))
    one = one.select(F.floor(F.col("doc_id") / 50).alias("range_id"), "seq", "doc_id", F.concat(F.lit("--- a/"), path, F.lit("\n+++ b/"), path, F.lit("\n"), "hunks").alias("t"))
    return one.groupBy("range_id", "seq").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "t"))), lambda x: x["t"]), "\n").alias("text"))


def range_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the commits of each range do, line by line, written."""
    lines = patches.patch_lines(range_patches(spark, sf_dir), "range_id", "seq")
    commit = (10 * F.col("range_id") + F.col("seq")).alias("commit")
    lines = settled(lines.select(F.col("range_id").alias("key"), "seq", commit, "path", "op", F.col("line_no").cast("long").alias("line_no"), "text"), "lines")
    swept(spark)
    return lines


@query("range_net_lines", f"WITH {NET_SQL} SELECT range_id, 'src/doc_' || CAST(doc_id AS VARCHAR) || '.txt' AS path, op, line_no, raw AS text FROM left_over")
def range_net_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each range adds and removes in all, decoded from its commits' patches."""
    return netdiff.net_of(range_lines(spark, sf_dir)).select(F.col("key").alias("range_id"), "path", "op", "line_no", "text")


@query("range_net_diff", f"""WITH {NET_SQL}, n AS (SELECT range_id, count(*) AS net_lines FROM left_over GROUP BY 1), s AS (SELECT range_id, count(*) AS sum_lines FROM (SELECT range_id, dies AS v FROM lives WHERE dies <= 4 UNION ALL SELECT range_id, born FROM lives WHERE born BETWEEN 1 AND 4) GROUP BY 1)
    SELECT range_id, sum_lines, coalesce(net_lines, 0) AS net_lines, sum_lines > 400 AS sum_over, coalesce(net_lines, 0) > 400 AS net_over FROM s LEFT JOIN n USING (range_id)""")  # fmt: skip
def range_net_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ranges against a budget: by what their commits change one by one, and by what is left of it."""
    lines = range_lines(spark, sf_dir)
    each = settled(lines.groupBy(F.col("key").alias("range_id")).agg(F.count("*").alias("sum_lines")), "sums")
    total = netdiff.net_of(lines).groupBy(F.col("key").alias("range_id")).agg(F.count("*").alias("net_lines"))
    out = each.join(total, "range_id", "left").withColumn("net_lines", F.coalesce("net_lines", F.lit(0)))
    return out.select("range_id", "sum_lines", "net_lines", (F.col("sum_lines") > 400).alias("sum_over"), (F.col("net_lines") > 400).alias("net_over"))


@query("commit_ordinals", f"WITH {A.CHANGES_SQL} SELECT branch AS key, row_number() OVER (PARTITION BY branch ORDER BY epoch(committed_at), change_id) AS ordinal, change_id AS \"commit\" FROM changes WHERE NOT is_merge")
def commit_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each branch's commits without merges, numbered from the oldest; a branch with most commits is ranked in blocks of time."""
    rows = A.changes(spark, sf_dir).where("not is_merge")
    dates = rows.select(F.col("change_id").alias("commit"), F.unix_timestamp("committed_at").alias("at"))
    return graph.numbered(rows.select(F.col("branch").alias("key"), F.col("change_id").alias("commit")), dates, 30 * 86_400)


POLICY_TEXT = """concat('{"mode":"', CASE c_custkey % 4 WHEN 0 THEN 'warn' WHEN 1 THEN 'enforce' WHEN 2 THEN 'ci_strict' ELSE 'loose' END, '","gates":{"diff_budget":{"max_lines":', cast(50 * (c_custkey % 7) - 50 AS string),
    CASE WHEN c_custkey % 5 = 0 THEN ',"max_line":3' ELSE '' END, '}}', CASE WHEN c_custkey % 6 = 0 THEN ',"extra":[1]' ELSE '' END, CASE WHEN c_custkey % 11 = 0 THEN ',"rule_overrides":{"scope/out-of-scope":"info"}' ELSE '' END, '}')"""


@query("policy_overlay", """WITH c AS (SELECT c_custkey AS repo, concat_ws(',', CASE WHEN c_custkey % 6 = 0 THEN 'extra' END, CASE WHEN c_custkey % 5 = 0 THEN 'gates.diff_budget.max_line' END) AS unknown,
        concat_ws('; ', CASE WHEN c_custkey % 7 = 0 THEN 'gates.diff_budget.max_lines: negative: -50' END, CASE WHEN c_custkey % 4 = 3 THEN 'mode: not a mode: "loose"' END) AS errors FROM customer WHERE c_custkey % 13 <> 0
        UNION ALL SELECT c_custkey, '', '' FROM customer WHERE c_custkey % 13 = 0)
    SELECT repo, unknown, errors, unknown = '' AND errors = '' AS holds, CASE WHEN unknown || errors = '' THEN CASE WHEN repo % 13 = 0 THEN '"enforce"' ELSE CASE repo % 4 WHEN 0 THEN '"warn"' WHEN 1 THEN '"enforce"' ELSE '"ci_strict"' END END END AS mode,
        CASE WHEN unknown || errors = '' THEN CASE WHEN repo % 13 = 0 THEN '300' ELSE CAST(50 * (repo % 7) - 50 AS VARCHAR) END END AS max_lines, CASE WHEN unknown || errors = '' THEN '20' END AS max_files,
        CASE WHEN unknown || errors = '' AND repo % 13 <> 0 AND repo % 11 = 0 THEN '"info"' END AS remapped FROM c""")  # fmt: skip
def policy_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policy files of many repositories over the defaults; every 13th has none."""
    rows = A.read(spark, sf_dir, "customer").selectExpr("c_custkey AS repo", f"{POLICY_TEXT} AS text")
    out = policies.overlaid(rows.where("repo % 13 <> 0"), rows.select("repo"))
    of = lambda key: F.try_element_at("settings", F.lit(key))
    return out.select(
        "repo", F.array_join("unknown", ",").alias("unknown"), F.array_join("errors", "; ").alias("errors"), F.col("settings").isNotNull().alias("holds"),
        of("mode").alias("mode"), of("gates.diff_budget.max_lines").alias("max_lines"), of("gates.diff_budget.max_files").alias("max_files"), of("rule_overrides.scope/out-of-scope").alias("remapped"),
    )
