"""Filters over raw occurrences and their merge into findings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from findlake.functions.scoring import SEVERITIES, parse_severity_filter, severity_from_rank
from findlake.operators.numbering import numbered


def severity_filter(df: DataFrame, spec: str, rank: str = "sev_rank") -> DataFrame:
    """Occurrences of the severities of ``spec``; applied before merging, so that others leave no trace."""
    return df.where(F.col(rank).isin(*[SEVERITIES.index(s) for s in parse_severity_filter(spec)]))


def plugin_filter(df: DataFrame, include: Sequence = (), exclude: Sequence = (), key: str = "key") -> DataFrame:
    """Keys of ``include``, if there are any, without those of ``exclude``."""
    if include:
        df = df.where(F.col(key).isin(*include))
    return df.where(~F.coalesce(F.col(key).isin(*exclude), F.lit(False))) if exclude else df


def min_confidence(df: DataFrame, least: int, qod: str = "qod") -> DataFrame:
    return df.where(F.col(qod) >= least)


def drop_snoozed(df: DataFrame, snoozed: str = "snoozed") -> DataFrame:
    return df.where(F.coalesce(F.trim(F.col(snoozed)), F.lit("")) == "")


def merge_occurrences(df: DataFrame, group: Sequence[str] = ("scan_id", "key"), component: str = "component", rank: str = "sev_rank", pos: str = "pos", first: Sequence[str] = (), most: Sequence[str] = ()) -> DataFrame:
    """One finding a group: highest severity, different non-empty components in order of first sight, the first
    occurrence's value of each column of ``first``, null or not, and the largest of each column of ``most``.

    Components are brought down to one row each before they are gathered, so that a check with millions of hits on few
    components is no hot spot; values of the first row ride along as a struct, so that one shuffle does for both.
    """
    group = list(group)
    head = F.struct(*[F.col(c) for c in (pos, *first)])
    name = F.when(F.trim(component) != "", F.col(component))
    each = df.groupBy(*group, name.alias("__component")).agg(F.max(rank).alias("__rank"), F.min(pos).alias("__pos"), F.min_by(head, F.col(pos)).alias("__head"), F.count("*").alias("__n"), *[F.max(c).alias(c) for c in most])
    ordered = F.array_sort(F.collect_list(F.when(F.col("__component").isNotNull(), F.struct("__pos", "__component"))))
    merged = each.groupBy(*group).agg(F.max("__rank").alias("sev_rank"), F.min("__pos").alias("first_pos"), F.min_by("__head", "__pos").alias("__first"), ordered.alias("__list"), F.sum("__n").alias("n_occurrences"), *[F.max(c).alias(c) for c in most])
    return merged.select(*group, "sev_rank", "first_pos", "n_occurrences", F.transform("__list", lambda s: s["__component"]).alias("components"), *[F.col(f"__first.{c}").alias(c) for c in first], *most)


def best_confidence(df: DataFrame, order: Sequence[str], group: Sequence[str] = ("key",), confidence: str = "confidence") -> DataFrame:
    """The highest confidence of each group as the tag ``confidence:x``; words that ``order`` lacks don't count."""
    rank = F.array_position(F.array(*[F.lit(c) for c in order]), F.col(confidence))
    return df.where(rank > 0).groupBy(*group).agg(F.concat(F.lit("confidence:"), F.max_by(confidence, rank)).alias("tag"))


def first_flag(df: DataFrame, flag: str, group: Sequence[str] = ("key",), pos: str = "pos") -> DataFrame:
    return df.groupBy(*group).agg(F.min_by(flag, pos).alias(flag))


def cross_scan_rollup(df: DataFrame, key: str = "key", scan: str = "scan_id", component: str = "component", rank: str = "sev_rank") -> DataFrame:
    """Findings over all scans: highest severity, scans and components counted; exact, in two steps without distinct on one key."""
    each = df.groupBy(key, scan, component).agg(F.max(rank).alias("r"), F.count("*").alias("n"))
    return each.groupBy(key).agg(F.max("r").alias("sev_rank"), F.countDistinct(scan).alias("n_scans"), F.countDistinct(component).alias("n_components"), F.sum("n").alias("n_occurrences"))


def scan_sketches(df: DataFrame, by: Sequence[str], scan: str = "scan_id", rank: str = "sev_rank", log_size: int = 12) -> DataFrame:
    """The columns ``by`` (a day and a key, say), sev_rank, scans and n_occurrences, where ``scans`` is a mergeable sketch of the scans.

    A sketch has at most 2^log_size registers, whatever it has seen; its error is about 1.04 / sqrt(2^log_size), 1.6 % at 12.
    """
    return df.groupBy(*by).agg(F.max(rank).alias("sev_rank"), F.hll_sketch_agg(F.col(scan).cast("string"), F.lit(log_size)).alias("scans"), F.count("*").alias("n_occurrences"))


def merge_sketches(sketches: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sketches of smaller groups, or of parts of the data, put together by the columns ``by``."""
    return sketches.groupBy(*by).agg(F.max("sev_rank").alias("sev_rank"), F.hll_union_agg("scans", F.lit(True)).alias("scans"), F.sum("n_occurrences").alias("n_occurrences"))


def approximate_rollup(sketches: DataFrame, key: str = "key") -> DataFrame:
    """``key, sev_rank, n_scans, n_occurrences`` over all sketches of a key; n_scans is estimated. No scan is read or shuffled again."""
    return merge_sketches(sketches, [key]).select(key, "sev_rank", F.hll_sketch_estimate("scans").alias("n_scans"), "n_occurrences")


def parse_summary(status: DataFrame) -> DataFrame:
    """Files by scanner and status with totals (null means all)."""
    return status.rollup("scanner", "status").agg(F.count("*").alias("n_files"))


def rank_findings(findings: DataFrame, scan: str = "scan_id") -> DataFrame:
    """``place`` in each scan: most severe first, ties in order of first sight."""
    return numbered(findings, [scan], [F.desc("sev_rank"), F.col("first_pos")], "place")


def top_instances(df: DataFrame, group: Sequence[str], order: Sequence[str], n: int = 20) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("place") <= n)


def default_finding_type(scanner: Column) -> Column:
    return F.when(scanner.isin("zap", "burp", "acunetix"), "web").otherwise("network")


def map_to_finding(merged: DataFrame, cwe_names: DataFrame) -> DataFrame:
    """Merged occurrences (key, title, sev_rank, components, cwe, cvss_error, scanner) as finding rows with their warnings.

    A bad CVSS vector and an unknown CWE are dropped with a warning; a blank title becomes ``Untitled finding``.
    """
    known = merged.join(cwe_names.select(F.col("cwe_id").alias("cwe"), F.col("name").alias("cwe_name")), "cwe", "left")
    warnings = F.array_compact(F.array(
        F.when(F.col("cvss_error").isNotNull(), F.concat(F.lit("cvss: "), F.col("cvss_error"))),
        F.when(F.col("cwe").isNotNull() & F.col("cwe_name").isNull(), F.concat(F.lit("cwe: unknown "), F.col("cwe").cast("string"))),
    ))
    return known.select(
        "key", F.when(F.coalesce(F.trim("title"), F.lit("")) == "", "Untitled finding").otherwise(F.trim("title")).alias("title"), severity_from_rank(F.col("sev_rank")).alias("severity"),
        default_finding_type(F.col("scanner")).alias("finding_type"), F.array_join("components", "\n").alias("affected_entities"), F.when(F.col("cwe_name").isNotNull(), F.col("cwe")).alias("cwe"), F.array_join(warnings, "; ").alias("warnings"),
    )
