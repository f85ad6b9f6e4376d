"""Near-duplicate functions: token streams without names and literals, compared by shared runs of tokens within a language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.sources.code import by_language
from palisade.sources.tables import settled

# Words that are no names, of the languages that functions are found in.
KEYWORDS = (
    "and as async await break case catch class const continue def default defer del do elif else except export extends finally for from func function go if "
    "import in interface is lambda let map new nonlocal not or package pass raise range return select static struct super switch this throw try type typeof var while with yield"
).split()
TOKEN = r"""("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|`[^`]*`|[0-9][\w.]*|[A-Za-z_$][\w$]*|:=|=>|->|==|!=|<=|>=|&&|\|\||\+\+|--|[^\w\s])"""


def folded(tokens: Column) -> Column:
    """Names as ``I`` and literals as ``L``; keywords, operators and brackets as they are."""
    keyword = F.array(*map(F.lit, KEYWORDS))
    return F.transform(tokens, lambda t: F.when(t.rlike(r"""^["'`0-9]"""), "L").when(t.rlike(r"^[A-Za-z_$]") & ~F.array_contains(keyword, t), "I").otherwise(t))


def streams(lines: DataFrame, functions: DataFrame) -> DataFrame:
    """``functions(path, lang, name, from_line, to_line)`` with ``tokens`` of ``lines(path, line_no, text)``, comments left out."""
    code = F.regexp_replace("text", F.lit(r"""("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|`[^`]*`)|//.*$|/\*.*?\*/"""), F.lit("$1"))
    hashed = F.regexp_replace("text", F.lit(r"""("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|#.*$"""), F.lit("$1"))
    each = functions.withColumn("line_no", F.explode(F.sequence("from_line", "to_line"))).join(lines.select("path", "line_no", "text").hint("merge"), ["path", "line_no"])
    # Folded, no token has a space in it, so a line's are one string until its function is put together.
    each = each.withColumn("t", F.array_join(folded(F.regexp_extract_all(by_language(F.col("lang"), lambda x: code if x.comment == "//" else hashed), F.lit(TOKEN), F.lit(1))), " ")).where("t <> ''")
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "t"))), lambda x: x["t"]), " ")
    return settled(each.groupBy("path", "lang", "name", "from_line", "to_line").agg(F.split(whole, " ").alias("tokens")), "streams")


def shingled(tokens: Column, width: int) -> Column:
    """The different runs of ``width`` tokens; of fewer tokens, all together."""
    n = F.greatest(F.size(tokens) - width, F.lit(0))
    return F.array_distinct(F.transform(F.sequence(F.lit(0), n), lambda i: F.array_join(F.slice(tokens, i + 1, width), " ")))


def near_duplicates(added: DataFrame, inventory: DataFrame, width: int = 5, percent: int = 85) -> DataFrame:
    """``path, name, from_line, similarity, match_path, match_name, match_line``: for each function of ``added`` the one of ``inventory`` most like it, if at least ``percent`` of the runs
    of ``width`` tokens that either has are in both; both from :func:`streams`. Only functions of one language are compared, none with itself; of equally good matches the first by path and line.

    Likeness is one of sets of runs, so functions with one set are one class, and copies are compared once. Two classes that are alike enough share one of their rarest runs, namely of the first
    ``n - ceil(percent * n / 100) + 1`` of ``n``: only these are joined on, so that what many functions have in common brings none together. Sizes that can't be
    alike enough are left out before the sets are compared.
    """
    place = F.struct("path", F.col("from_line").alias("line"), "name")
    own = added.select("lang", "path", "name", "from_line", F.lit(True).alias("new"), "tokens").unionByName(inventory.select("lang", "path", "name", "from_line", F.lit(False).alias("new"), "tokens"))
    own = own.select("lang", place.alias("place"), "new", F.array_sort(shingled(F.col("tokens"), width)).alias("runs"))
    own = settled(own.select("lang", "place", "new", F.sha2(F.to_json("runs"), 256).alias("set"), "runs"), "sets")
    # The two first places: a function may be its class's first itself.
    ordered = Window.partitionBy("lang", "set").orderBy("place")
    first = own.where("not new").select("lang", "set", "place", F.dense_rank().over(ordered).alias("_n")).where("_n <= 2").groupBy("lang", "set").agg(F.array_sort(F.collect_set("place")).alias("places"))
    classes = own.groupBy("lang", "set").agg(F.first("runs").alias("runs"), F.bool_or("new").alias("asked")).join(first, ["lang", "set"], "left")
    classes = settled(classes.select(F.monotonically_increasing_id().alias("id"), "lang", "set", "runs", "places", "asked"), "classes")
    runs = classes.select("lang", "id", "asked", F.col("places").isNotNull().alias("there"), F.size("runs").alias("n"), F.explode("runs").alias("run"))
    common = runs.groupBy("lang", "run").agg(F.count("*").alias("df"))
    rare = Window.partitionBy("id").orderBy("df", "run")
    needed = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    prefix = runs.join(common, ["lang", "run"]).withColumn("_at", F.row_number().over(rare)).where(F.col("_at") <= needed)
    left = prefix.where("asked").select("lang", "run", "id", "n")
    right = prefix.where("there").select("lang", "run", F.col("id").alias("_id"), F.col("n").alias("_n"))
    pairs = left.join(right, ["lang", "run"]).where((F.least("n", "_n") * 100 >= F.greatest("n", "_n") * percent) & (F.col("id") != F.col("_id"))).select("id", "_id").distinct()
    both = pairs.join(classes.select("id", "lang", "set", "runs"), "id").join(classes.select(F.col("id").alias("_id"), F.col("runs").alias("_runs"), "places"), "_id")
    shared, either = F.size(F.array_intersect("runs", "_runs")), F.size(F.array_union("runs", "_runs"))
    alike = both.withColumn("similarity", shared / either).where(shared * 100 >= either * percent).select("lang", "set", "similarity", "places")
    alike = alike.unionByName(classes.where(F.col("asked") & F.col("places").isNotNull()).select("lang", "set", F.lit(1.0).alias("similarity"), "places"))
    # Of a class's matches, too, two are enough for each of its functions.
    each = alike.select("lang", "set", F.explode("places").alias("m"), "similarity").groupBy("lang", "set", "m").agg(F.max("similarity").alias("similarity"))
    best = each.withColumn("_n", F.row_number().over(Window.partitionBy("lang", "set").orderBy(F.desc("similarity"), "m"))).where("_n <= 2")
    best = best.groupBy("lang", "set").agg(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("s"), "m"))).alias("best"))
    found = own.where("new").select("lang", "set", "place").join(best, ["lang", "set"])
    found = found.withColumn("b", F.get(F.filter("best", lambda x: ~x["m"].eqNullSafe(F.col("place"))), F.lit(0))).where("b is not null")
    found = found.groupBy("place").agg(F.min("b").alias("b"))
    return found.select("place.path", "place.name", F.col("place.line").alias("from_line"), (-F.col("b.s")).alias("similarity"), F.col("b.m.path").alias("match_path"), F.col("b.m.name").alias("match_name"), F.col("b.m.line").alias("match_line"))


def finding_rows(found: DataFrame) -> DataFrame:
    """Findings of :func:`near_duplicates`, with the share as a percentage and the match's place as the suggestion."""
    where = F.concat("match_path", F.lit(":"), F.col("match_line").cast("string"))
    share = F.concat(F.round(100 * F.col("similarity")).cast("int").cast("string"), F.lit("%"))
    message = F.concat(F.lit("function "), "name", F.lit(" is "), share, F.lit(" alike "), "match_name", F.lit(" in "), "match_path")
    return found.select(
        F.col("path").alias("file"), F.col("from_line").alias("line"), F.lit("no-duplicate-function").alias("rule_id"), F.lit("warn").alias("severity"), message.alias("message"),
        F.concat(F.lit("see "), "match_name", F.lit(" at "), where).alias("suggestion"), F.concat(F.lit("Call "), "match_name", F.lit(" ("), where, F.lit(") in place of a copy.")).alias("retry_hint"),
    )
