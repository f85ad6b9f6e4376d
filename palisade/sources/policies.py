"""Policy files of many repositories: nested settings as dotted keys, laid over the defaults, with what is wrong in each."""

from __future__ import annotations

import json
from dataclasses import fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.operators.policy import MODES, REMAPPED, SETTINGS, SEVERITIES, Policy

#: Settings stand three names deep at most, rules' severities two.
DEPTH = 3


def defaults() -> dict[str, str]:
    """The compiled-in settings, as JSON by dotted key."""
    known = {f.name: getattr(Policy(), f.name) for f in fields(Policy)}
    own = {"version": 1, "gates.ai_patterns.enabled": True}
    return {key: json.dumps(own[key] if key in own else list(known[field]) if isinstance(known[field], tuple) else known[field], separators=(",", ":")) for key, (field, _) in SETTINGS.items()}


def flattened(files: DataFrame) -> DataFrame:
    """``repo, key, value`` of ``files(repo, text)``: each leaf of a JSON document under its dotted key, a list being a leaf; an object without names is a leaf too.

    Names under ``rule_overrides`` are one leaf each, whatever they hold: rules have slashes, not depth.
    """
    tree = files.select("repo", F.lit("").alias("key"), F.try_parse_json("text").alias("v")).where("v is not null")
    out = None
    for depth in range(DEPTH + 1):
        inner = (F.schema_of_variant("v").startswith("OBJECT<") & (F.schema_of_variant("v") != "OBJECT<>")) & (F.lit(depth < DEPTH) & ~F.col("key").startswith(f"{REMAPPED}."))
        leaves = tree.where(~inner).select("repo", "key", F.to_json("v").alias("value"))
        out = leaves if out is None else out.unionByName(leaves)
        if depth < DEPTH:
            # An object's names: a map of variants, entry by entry.
            each = F.explode(F.map_entries(F.variant_get("v", "$", "map<string,variant>"))).alias("e")
            tree = tree.where(inner).select("repo", "key", each).select("repo", F.concat(F.when(F.col("key") == "", "").otherwise(F.concat("key", F.lit("."))), "e.key").alias("key"), F.col("e.value").alias("v"))
    return out.where("key <> ''")


def wrong(key: Column, value: Column) -> Column:
    """What is wrong with a known setting's value, null if nothing is."""
    kind = F.element_at(F.create_map(*[F.lit(x) for k, (_, t) in SETTINGS.items() for x in (k, t)]), key)
    fits = F.when(kind == "int", value.rlike(r"^-?[0-9]+\z")).when(kind == "boolean", value.isin("true", "false")).when(kind == "list", value.startswith("[")).otherwise(value.startswith('"'))
    said = lambda text: F.concat(key, F.lit(f": {text}: "), value)
    quoted = lambda xs: [json.dumps(x) for x in xs]
    severity = key.startswith(f"{REMAPPED}.")
    return (
        F.when(severity & ~value.isin(*quoted(SEVERITIES)), said("not a severity")).when(severity, F.lit(None))
        .when(~fits, said("not of its kind")).when((key == "mode") & ~value.isin(*quoted(MODES)), said("not a mode"))
        .when((key == "provenance.apply_gates_to") & ~value.isin(*quoted(("all-commits", "agent-only", ""))), said("not a scope of gates"))
        .when(key.startswith("gates.diff_budget.max_") & value.startswith("-"), said("negative"))
    )


def overlaid(files: DataFrame, repos: DataFrame) -> DataFrame:
    """``repo, settings, unknown, errors`` of each of ``repos(repo)``: the defaults with what its file in ``files(repo, text)`` gives, all settings as JSON by dotted key.

    Fails closed: with unknown keys (named, sorted), bad values or a text that is no JSON object, ``settings`` is null. A repository without a file, or with an empty one, has the
    defaults. A group's name where a value belongs, as ``gates`` for a number, is an unknown key.
    """
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    some = files.where(~blank)
    parsed = F.try_parse_json("text")
    bad = some.where(parsed.isNull() | ~F.schema_of_variant(parsed).startswith("OBJECT<")).select("repo", F.lit("not an object").alias("error"))
    rows = flattened(some.join(bad.select("repo"), "repo", "left_anti"))
    known = F.col("key").isin(*SETTINGS) | F.col("key").startswith(f"{REMAPPED}.") | ((F.col("key") == REMAPPED) & (F.col("value") == "{}"))
    rows = rows.withColumns({"_known": known, "error": F.when(known, wrong(F.col("key"), F.col("value")))})
    own = rows.groupBy("repo").agg(
        F.map_from_entries(F.array_compact(F.collect_list(F.when(F.col("_known"), F.struct("key", "value"))))).alias("given"),
        F.array_sort(F.collect_set(F.when(~F.col("_known"), F.col("key")))).alias("unknown"), F.array_sort(F.collect_set("error")).alias("errors"),
    )
    base = F.create_map(*[F.lit(x) for pair in defaults().items() for x in pair])
    out = repos.select("repo").distinct().join(own, "repo", "left").join(bad.groupBy("repo").agg(F.max("error").alias("_bad")), "repo", "left")
    none = F.array().cast("array<string>")
    errors = F.when(F.col("_bad").isNotNull(), F.array("_bad")).otherwise(F.coalesce("errors", none))
    unknown = F.coalesce("unknown", none)
    given = F.coalesce("given", F.create_map().cast("map<string,string>"))
    settings = F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(given, k)), given)
    return out.select("repo", F.when((F.size(errors) == 0) & (F.size(unknown) == 0), settings).alias("settings"), unknown.alias("unknown"), errors.alias("errors"))
