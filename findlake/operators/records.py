"""Canonical forms of records, events and snapshots of a run, and the sink of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findlake.operators.numbering import folder_exists, settle

from findlake.functions.text import html_escape

#: Outcomes that need attention; a skip does where its reason says so.
PROBLEMS = ["INVALID", "COLLISION", "FAILED", "WITHHELD"]


def is_problem(outcome: Column, severity: Column) -> Column:
    """Whether a record needs attention; ``severity`` (ATTENTION or INFO) counts for skips only."""
    return F.coalesce(F.when(outcome == "SKIP", severity == "ATTENTION").otherwise(outcome.isin(*PROBLEMS)), F.lit(False))


def exit_code(plan: DataFrame, *group: str) -> DataFrame:
    """``exit_code`` of a run: 1 where any record needs attention."""
    return plan.groupBy(*group).agg(F.max(is_problem(F.col("outcome"), F.col("severity")).cast("int")).alias("exit_code"))


# Canonical forms: what is hashed of a record, alike on both sides.


def canonical_title(title: Column) -> Column:
    return F.when(F.trim(F.coalesce(title, F.lit(""))) == "", "Untitled").otherwise(F.trim(title))


def _cwe_of(tag: Column) -> Column:
    return F.concat(F.lit("CWE-"), F.trim(F.regexp_replace(tag, r"(?i)^CWE[:-](?:CWE-)?", "")))


def split_tags(tags: Column, known: Column) -> Column:
    """``struct(cwe, tags)``: tags that name a known weakness (an array of CWE-n) as sorted CWE-n, each once; the others sorted."""
    named = lambda t: F.upper(t).rlike("^CWE[:-]") & F.array_contains(known, _cwe_of(t))
    return F.struct(
        F.array_sort(F.array_distinct(F.transform(F.filter(tags, named), _cwe_of))).alias("cwe"), F.array_sort(F.filter(tags, lambda t: ~named(t))).alias("tags"),
    )


def tags_to_local(tags: Column) -> Column:
    """An array of struct(name, value) as ``name:value``, or the bare name where there is no value."""
    return F.transform(tags, lambda t: F.when(F.coalesce(t["value"], F.lit("")) != "", F.concat_ws(":", F.coalesce(t["name"], F.lit("")), t["value"])).otherwise(F.coalesce(t["name"], F.lit(""))))


def tags_to_remote(tags: Column) -> Column:
    """The way back: cut at the first colon."""
    return F.transform(tags, lambda t: F.struct(F.element_at(F.split(t, ":", 2), 1).alias("name"), F.coalesce(F.get(F.split(t, ":", 2), F.lit(1)), F.lit("")).alias("value")))


def entities_to_html(text: Column) -> Column:
    """Lines that aren't blank as one paragraph with breaks."""
    kept = F.filter(F.split(text, "\r?\n"), lambda x: F.trim(x) != "")
    return F.concat(F.lit("<p>"), F.array_join(F.transform(kept, html_escape), "<br>"), F.lit("</p>"))


def entities_from_html(html: Column) -> Column:
    inner = F.regexp_replace(F.trim(html), r"(?s)^<p>(.*)</p>$", "$1")
    out = F.array_join(F.filter(F.split(inner, "<br>"), lambda x: F.trim(x) != ""), "\n")
    for safe, raw in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(safe), F.lit(raw))
    return out


# Runs


def verb(outcome: Column) -> Column:
    """The verb of an outcome's event."""
    return F.when(outcome == "MOVE_EDIT", "move").otherwise(F.replace(F.lower(outcome), F.lit("_"), F.lit("-")))


def events(plan: DataFrame, dry_run: bool = False, verbose: bool = False) -> DataFrame:
    """``verb, subject, line, severity`` of a plan (outcome, path, label, kind, id, detail, severity): clean records say nothing, INFO is hidden unless ``verbose``.

    The subject is the path, else the remote's label, else kind and id.
    """
    subject = F.coalesce("path", "label", F.concat_ws(" ", "kind", F.col("id").cast("string")))
    shown = plan.where("outcome <> 'CLEAN'")
    if not verbose:
        shown = shown.where(~F.col("severity").eqNullSafe("INFO"))
    v = verb(F.col("outcome"))
    line = F.concat(F.lit("would " if dry_run else ""), v, F.lit(" "), subject, F.when(F.coalesce("detail", F.lit("")) != "", F.concat(F.lit(" — "), F.col("detail"))).otherwise(""))
    return shown.select(v.alias("verb"), subject.alias("subject"), line.alias("line"), "severity")


def losses(messages: DataFrame) -> DataFrame:
    """``path, detail`` of lost constructs, each once a path however often a record was converted."""
    return messages.select("path", "detail").distinct()


def snapshot_summary(log: DataFrame) -> DataFrame:
    """``run_id, counts, kinds``: of each recorded run how often each verb (``verb n`` in order) and which kinds."""
    counted = log.groupBy("run_id", verb(F.col("outcome")).alias("verb")).agg(F.count("*").alias("n"), F.collect_set("kind").alias("kinds"))
    parts = F.array_sort(F.collect_list(F.struct("verb", "n")))
    return counted.groupBy("run_id").agg(
        F.array_join(F.transform(parts, lambda s: F.concat(s["verb"], F.lit(" "), s["n"].cast("string"))), ", ").alias("counts"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("kinds")))), ",").alias("kinds"),
    )


def last_run(runs: DataFrame) -> DataFrame:
    """``phase, at, status``: the latest of each phase; of equal times the status that sorts last."""
    return runs.groupBy("phase").agg(F.max(F.struct("at", "status")).alias("s")).select("phase", F.col("s.at").alias("at"), F.col("s.status").alias("status"))


def write_states(findings: DataFrame, existing: DataFrame) -> DataFrame:
    """``path, content, state`` of a write of findings (path, content) over files (path, content): unchanged ones are not written again.

    A finding without content fails by itself.
    """
    old = existing.select("path", F.sha2(F.col("content"), 256).alias("__old"))
    state = F.when(F.col("content").isNull(), "failed").when(F.sha2("content", 256) == F.col("__old"), "unchanged").otherwise("written")
    return findings.join(old, "path", "left").select("path", "content", state.alias("state"))


def write_findings(findings: DataFrame, table: str, buckets: int = 64) -> DataFrame:
    """Write findings (path, content; a row a path) into ``table`` and return ``path, state``: written, unchanged or failed.

    The table is Parquet, cut in ``buckets`` by path. Only buckets that have a finding to write are written anew, with what they held
    of other paths; the other buckets' files are not touched, and a run without a change writes no file. A finding without content
    fails: its path keeps what it had, and the others are written. What goes out is settled before any old file is replaced.
    """
    spark = findings.sparkSession
    schema = "path string, content string, bucket int"
    there = folder_exists(spark, table)
    old = spark.read.schema(schema).parquet(table) if there else spark.createDataFrame([], schema)
    told = settle(write_states(findings.select("path", "content"), old).withColumn("bucket", F.pmod(F.xxhash64("path"), F.lit(buckets)).cast("int")))
    touched = told.where("state = 'written'").select("bucket").distinct()
    if not touched.isEmpty():
        coming = told.where("state = 'written'").select("path", "content", "bucket")
        kept = old.join(touched, "bucket", "left_semi").join(coming.select("path"), "path", "left_anti").select("path", "content", "bucket")
        out = settle(kept.unionByName(coming).repartition("bucket"))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(table)
    return told.select("path", "state")
