"""The output contract: findings on match and candidate lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXAMPLES = 5
#: Findings in the order in which they are reported; all but the last are errors.
RULES = ("malformed", "duplicate_row", "duplicate_id", "self_match", "bad_prefix", "unknown_id", "missing_s1", "extra_s1", "not_candidate")


def split_ids(ids):
    return F.when(F.trim(F.coalesce(ids, F.lit(""))) == "", F.array().cast("array<string>")).otherwise(F.split(ids, ","))


def offenders(rows: DataFrame, rule: str, what) -> DataFrame:
    return rows.select(F.lit(rule).alias("rule"), what.cast("string").alias("what"))


def findings(rows: DataFrame, required: DataFrame, valid: DataFrame | None = None, candidates: DataFrame | None = None) -> DataFrame:
    """rule and what for each offence. rows: s1_id, ids (comma-joined); required: s1_id; valid: entity_id; candidates as rows."""
    lists = rows.select("s1_id", split_ids(F.col("ids")).alias("l"))
    each = lists.select("s1_id", F.explode("l").alias("id"))
    own, asked = rows.select("s1_id").distinct(), required.select("s1_id").distinct()
    pair = F.concat("s1_id", F.lit(" -> "), "id")
    found = [
        offenders(rows.groupBy("s1_id").count().filter("count > 1"), "duplicate_row", F.col("s1_id")),
        offenders(lists.filter(F.size("l") != F.size(F.array_distinct("l"))), "duplicate_id", F.col("s1_id")),
        offenders(each.filter(F.col("id").startswith("S1-")), "self_match", pair),
        offenders(each.filter(~F.col("id").rlike("^S[123]-")), "bad_prefix", pair),
        offenders(asked.join(own, "s1_id", "left_anti"), "missing_s1", F.col("s1_id")),
        offenders(own.join(asked, "s1_id", "left_anti"), "extra_s1", F.col("s1_id")),
    ]
    if valid is not None:
        known = valid.select(F.col("entity_id").alias("id")).distinct()
        found.append(offenders(each.filter(F.col("id").rlike("^S[23]-")).join(known, "id", "left_anti"), "unknown_id", pair))
    if candidates is not None:
        allowed = candidates.select("s1_id", F.explode(split_ids(F.col("ids"))).alias("id")).distinct()
        found.append(offenders(each.join(allowed, ["s1_id", "id"], "left_anti"), "not_candidate", pair))
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


def report(found: DataFrame) -> DataFrame:
    """rule, severity, n and the first EXAMPLES offences in order, for rules with any."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("rule").orderBy("what"))
    n = found.groupBy("rule").agg(F.count("*").alias("n"))
    some = found.distinct().withColumn("r", rank).filter(F.col("r") <= EXAMPLES).groupBy("rule").agg(F.array_join(F.array_sort(F.collect_list("what")), "; ").alias("examples"))
    severity = F.when(F.col("rule") == "not_candidate", "warning").otherwise("error")
    return n.join(some, "rule").select("rule", severity.alias("severity"), "n", "examples")


def summary(rows: DataFrame) -> DataFrame:
    filled = F.trim(F.coalesce("ids", F.lit(""))) != ""
    return rows.agg(F.count("*").alias("n_rows"), F.count_if(~filled).alias("n_empty"), F.count_if(filled).alias("n_filled"))


def header_errors(first_line: str | None, expected: list[str]) -> list[str]:
    """What is wrong with a file's first line."""
    if first_line is None or first_line == "":
        return ["file is empty"]
    if "\t" not in first_line and "," in first_line:
        return ["file looks comma-separated"]
    names = [x.strip().lower() for x in first_line.split("\t")]
    return [] if names == expected else [f"header is {names}, not {expected}"]


def malformed(lines: DataFrame) -> DataFrame:
    """Findings for lines (value, and line where numbers are known) that are not blank and have no tab."""
    what = F.concat(F.lit("line "), F.col("line").cast("string"), F.lit(": "), F.col("value")) if "line" in lines.columns else F.col("value")
    return offenders(lines.filter((F.trim("value") != "") & ~F.col("value").contains("\t")), "malformed", what)


def numbered(spark, path: str) -> DataFrame:
    """value, file and line (from 1) of the lines of a text file or of each file of a folder.

    A line's number is its place in its split and the lines of the file's earlier splits, counted with one narrow row a split.
    """
    from pyspark.sql import Window

    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("id"))
    splits = lines.groupBy("file", "at").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "at", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return lines.join(splits, ["file", "at"]).select("value", "file", (F.col("before") + F.col("id") - F.col("first") + 1).alias("line"))


def passes(reported: DataFrame) -> bool:
    """Whether no error, warnings aside, was reported."""
    return reported.filter("severity = 'error'").limit(1).count() == 0


def exists(spark, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def read_lists(spark, path: str, expected: list[str]) -> tuple[DataFrame | None, DataFrame | None, list[str]]:
    """Rows (s1_id, ids) and malformed lines of a list file, or what keeps it from being read. Blank lines are ignored."""
    if not exists(spark, path):
        return None, None, [f"{path} does not exist"]
    lines = numbered(spark, path)
    if lines.filter(~F.is_valid_utf8("value")).limit(1).count():
        return None, None, [f"{path} is not UTF-8"]
    heads = [r["value"] for r in lines.filter("line = 1").select("value").distinct().limit(2).collect()]  # every file of a folder has the header
    wrong = [e for h in heads or [None] for e in header_errors(h, expected)]
    if wrong:
        return None, None, wrong
    body = lines.filter("line > 1")
    parts = F.split("value", "\t", 2)
    rows = body.filter(F.col("value").contains("\t")).select(F.trim(F.get(parts, F.lit(0))).alias("s1_id"), F.trim(F.get(parts, F.lit(1))).alias("ids"))
    return rows, malformed(body), []


def validate_files(spark, matches: str, candidates: str | None, required: str, targets: tuple[str, ...] = ()) -> tuple[list[str], list[str], DataFrame | None]:
    """Errors, warnings and the report of a match file and its optional candidate file.

    required: the file of query entities; targets: files of target entities, whose ids are checked where they exist.
    """
    from kinlink.sources import tsv

    if not exists(spark, required):
        return [f"{required} does not exist"], [], None
    rows, bad, errors = read_lists(spark, matches, tsv.MATCHES)
    if errors:
        return errors, [], None
    warnings, cand, valid = [], None, None
    if candidates is None or not exists(spark, candidates):
        warnings.append("no candidate file: matches are not checked against candidates")
    else:
        cand, cand_bad, errors = read_lists(spark, candidates, tsv.CANDIDATES)
        bad = bad.union(cand_bad) if cand_bad is not None else bad
    if targets and all(exists(spark, t) for t in targets):
        valid = tsv.id_column(spark, targets[0])
        for t in targets[1:]:
            valid = valid.union(tsv.id_column(spark, t))
    else:
        warnings.append("no target files: ids are not checked")
    need = tsv.id_column(spark, required).withColumnRenamed("entity_id", "s1_id")
    out = report(findings(rows, need, valid, cand).union(bad))
    for r in out.collect():  # one row for each rule
        (warnings if r["severity"] == "warning" else errors).append(f"{r['rule']}: {r['n']} ({r['examples']})")
    return errors, warnings, out
