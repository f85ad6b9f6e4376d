"""The driver's tables seen as changes, files, added lines, markers and logs: a fixed relabelling, in SQL that both engines read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHANGES = {
    "change_id": "o_orderkey",
    "committed_at": "o_orderdate",
    "branch": "CASE o_orderkey % 10 WHEN 0 THEN 'main' WHEN 1 THEN concat('release/', cast(o_custkey % 5 AS string)) WHEN 2 THEN concat('release/1/', cast(o_custkey % 5 AS string))"
    " WHEN 3 THEN concat('agent/AUTH-', cast(o_custkey AS string), '-fix') WHEN 4 THEN concat('ai/task-', cast(o_custkey AS string)) WHEN 5 THEN 'bot/refactor' ELSE concat('feature/jira-', cast(o_custkey AS string), '_x') END",
    "message": "concat('Change ', cast(o_orderkey AS string), chr(10), CASE o_custkey % 7 WHEN 0 THEN 'Co-Authored-By: Cursor <agent@example.org>' WHEN 1 THEN 'co-authored-by: Alice <alice@example.org>' ELSE '' END,"
    " CASE WHEN o_orderkey % 17 = 0 THEN concat(chr(10), 'Policy-Override: no-broad-catch', chr(10), '  Policy-Override:  no-new-lint-suppressions', chr(10), 'policy-override: scope') ELSE '' END)",
    "env_agent": "CASE WHEN o_custkey % 11 = 0 THEN 'Devin' ELSE '' END",
    "env_override": "CASE WHEN o_orderkey % 23 = 0 THEN ' no-broad-catch,,no-such-rule ' ELSE '' END",
    "is_merge": "o_orderkey % 13 = 0",
    "tree_hash": "md5(cast(o_orderkey AS string))",
}
PATH = "concat(lower(p_type), '/', lower(replace(p_brand, '#', '')), '/', replace(p_name, ' ', '_'), CASE WHEN p_size % 10 = 0 THEN '.lock' ELSE '.go' END)"
KIND = "CASE WHEN l_returnflag = 'A' THEN 'added' WHEN l_returnflag = 'N' THEN 'modified' WHEN l_linestatus = 'F' THEN 'deleted' ELSE 'renamed' END"

CHANGES_SQL = f"changes AS (SELECT {', '.join(f'{v} AS {k}' for k, v in CHANGES.items())} FROM orders)"
FILES_SQL = f"""files AS (SELECT l_orderkey AS change_id, {PATH} AS path, min({KIND}) AS kind, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS added,
    CAST(sum(CAST(l_linenumber AS BIGINT)) AS BIGINT) AS removed FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""
LINES_SQL = """added_lines AS (SELECT change_id, path, CAST(p + 1 AS BIGINT) AS line_no,
    CASE WHEN (31 * change_id + p) % 97 = 0 THEN concat(raw, '  # noqa') WHEN (31 * change_id + p) % 101 = 0 THEN 'except:' ELSE raw END AS text
    FROM (SELECT doc_id AS change_id, concat(lang, '/', source, '/doc_', CAST(doc_id AS VARCHAR), '.txt') AS path, string_split(text, chr(10)) AS ls, unnest(string_split(text, chr(10))) AS raw,
          generate_subscripts(string_split(text, chr(10)), 1) - 1 AS p FROM documents))"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").selectExpr(*[f"{v} AS {k}" for k, v in CHANGES.items()])


def file_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a line item: change, path, kind, counts."""
    parts = read(spark, sf_dir, "part").selectExpr("p_partkey", f"{PATH} AS path")
    items = read(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS change_id", "l_partkey", f"{KIND} AS kind", "cast(l_quantity AS bigint) AS added", "cast(l_linenumber AS bigint) AS removed")
    return items.join(parts, items["l_partkey"] == parts["p_partkey"]).drop("l_partkey", "p_partkey")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_parts(spark, sf_dir).groupBy("change_id", "path").agg(F.min("kind").alias("kind"), F.sum("added").alias("added"), F.sum("removed").alias("removed"))


def added_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    path = F.concat("lang", F.lit("/"), "source", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    rows = docs.select(F.col("doc_id").alias("change_id"), path.alias("path"), F.posexplode(F.split("text", "\n", -1)).alias("p", "raw"))
    at = 31 * F.col("change_id") + F.col("p")
    text = F.when(at % 97 == 0, F.concat("raw", F.lit("  # noqa"))).when(at % 101 == 0, F.lit("except:")).otherwise(F.col("raw"))
    return rows.select("change_id", "path", (F.col("p") + 1).cast("long").alias("line_no"), text.alias("text"))


def markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees that a check has passed."""
    return changes(spark, sf_dir).where("change_id % 3 <> 0").select("tree_hash")


def bypass_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-shot tokens: when they were armed, on which branch."""
    return changes(spark, sf_dir).where("change_id % 29 = 0").select("branch", F.expr("committed_at - interval 1 hour").alias("ts"))
