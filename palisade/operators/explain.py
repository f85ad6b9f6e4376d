"""What a rule is about: a small table of entries, joined with the ids that are asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.operators.engine import with_docs
from palisade.operators.gates import GATES
from palisade.operators.policy import RULES

ENTRIES = (
    ("branch_policy", "protected-branch", "Agents don't commit to protected branches.", "live"),
    ("diff_budget", "max-lines", "A change has a limit of changed lines.", "live"),
    ("diff_budget", "max-files", "A change has a limit of changed files.", "live"),
    ("diff_budget", "max-new-files", "A change has a limit of new files.", "live"),
    ("scope", "out-of-scope", "A change stays within the paths its task declares.", "live"),
    ("scope", "missing-manifest", "A change declares the paths of its task.", "live"),
    ("diff_coverage", "min-percent", "Added lines had to be covered by tests.", "removed"),
    ("ai_patterns", "no-hardcoded-secrets", "Keys don't belong into code.", "removed"),
    *(("ai_patterns", r.rule_id, r.message, "live") for r in RULES),
)


def entries(spark: SparkSession) -> DataFrame:
    return with_docs(spark.createDataFrame(list(ENTRIES), "gate string, rule_id string, summary string, state string"))


def explained(asked: DataFrame, table: DataFrame) -> DataFrame:
    """``asked(rule)`` with ``rule_id, summary, docs_url, state, exit_code``: a gate's name before the id is taken off; an unknown id is exit code 2, a rule that is no more says so."""
    prefix = "^(?:" + "|".join([*GATES, "diff_coverage"]) + ")/"
    key = F.regexp_replace("rule", prefix, "")
    found = asked.withColumn("rule_id", key).join(F.broadcast(table.select("rule_id", "summary", "docs_url", "state")), "rule_id", "left")
    return found.select("rule", "rule_id", "summary", "docs_url", F.coalesce("state", F.lit("unknown")).alias("state"), F.when(F.col("summary").isNull(), 2).otherwise(0).alias("exit_code"))


def pass_count(listed: DataFrame) -> DataFrame:
    """``n_ok, n_rules, exit_code`` of a listing with ``failures``."""
    ok = F.count_if(F.col("failures") == 0)
    return listed.agg(ok.alias("n_ok"), F.count("*").alias("n_rules"), F.when(ok == F.count("*"), 0).otherwise(1).alias("exit_code"))
