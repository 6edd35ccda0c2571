"""Rules over pages, findings, notes and generated files, one table of failures each."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from findlake.functions.scoring import cvss_base_score, severity_band
from findlake.functions.text import extension_problem, file_name_problem, good_segment, known_place
from findlake.operators.documents import failure, frontmatter_split, lf_text, mark_fences, references

#: The fields of a page's frontmatter.
PAGE_FIELDS = ["title", "priority", "tags"]
#: The element names of HTML.
HTML_TAGS = (
    "a abbr address area article aside audio b base bdi bdo blockquote body br button canvas caption cite code col colgroup data datalist dd del details dfn dialog div dl dt em embed "
    "fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html i iframe img input ins kbd label legend li link main map mark menu meta meter nav noscript "
    "object ol optgroup option output p param picture pre progress q rp rt ruby s samp script section select slot small source span strong style sub summary sup table tbody td "
    "template textarea tfoot th thead time title tr track u ul var video wbr"
).split()
MARKUP = r"<(?:!|\?|/?\s*([A-Za-z][A-Za-z0-9-]*))[^>]*>"


def all_failures(*tables: DataFrame) -> DataFrame:
    """The failures of many rules as one list: rule_id, doc_id, line, message."""
    return reduce(DataFrame.unionByName, tables)


def page_frontmatter_rules(docs: DataFrame) -> DataFrame:
    """WIKI-001 to WIKI-003 of pages (doc_id, fields map<string, string>): unknown fields, no title, a priority that is no integer."""
    fields = F.coalesce("fields", F.create_map().cast("map<string,string>"))
    value = lambda name: F.try_element_at(fields, F.lit(name))
    unknown = docs.select("doc_id", F.explode(F.array_except(F.map_keys(fields), F.array(*[F.lit(f) for f in PAGE_FIELDS]))).alias("field"))
    untitled = docs.where(F.trim(F.coalesce(value("title"), F.lit(""))) == "")
    priority = docs.where(value("priority").isNotNull() & ~F.coalesce(value("priority"), F.lit("")).rlike(r"^\s*[+-]?[0-9]+\s*$")).select("doc_id", value("priority").alias("p"))
    return all_failures(failure(unknown, "WIKI-001", F.col("field")), failure(untitled, "WIKI-002", "no title"), failure(priority, "WIKI-003", F.col("p")))


def raw_html_rule(line_rows: DataFrame) -> DataFrame:
    """WIKI-005: HTML outside code; a name that is no element is a placeholder, a comment or declaration is HTML."""
    plain = mark_fences(line_rows).where("not in_code").withColumn("plain", F.regexp_replace("content", r"`[^`]*`", ""))
    found = plain.select("doc_id", "line", F.explode(F.regexp_extract_all("plain", F.lit(MARKUP), 0)).alias("m"))
    name = F.lower(F.regexp_extract("m", MARKUP, 1))
    return failure(found.where((name == "") | name.isin(*HTML_TAGS)), "WIKI-005", F.substring("m", 1, 60), F.col("line"))


def title_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """FND-013 and FND-016 of findings' bodies: no title or a blank one in front, and text between the title and the first section.

    A title is the first line before any section that starts with ``# ``; text in front of it is a missing title, reported at its first line.
    """
    head = F.get(F.split(lf_text(F.col(text_col)), r"(?md)^## ", 2), F.lit(0))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.split(head, "\n", -1).alias("l"))
    rows = rows.withColumn("at", F.array_position(F.transform("l", lambda x: x.startswith("# ")), F.lit(True)))
    texts = F.filter(F.transform("l", lambda x, i: F.struct((i + 1).alias("line"), x.alias("content"))), lambda x: (F.trim(x["content"]) != "") & (x["line"] != F.col("at")))
    rows = rows.select("doc_id", "at", F.get("l", F.col("at").cast("int") - 1).alias("title"), F.filter(texts, lambda x: (F.col("at") == 0) | (x["line"] < F.col("at"))).alias("front"), F.filter(texts, lambda x: (F.col("at") > 0) & (x["line"] > F.col("at"))).alias("after"))
    missing = failure(rows.where((F.col("at") == 0) | (F.size("front") > 0)), "FND-013", "missing title", F.get("front", F.lit(0))["line"])
    blank = failure(rows.where((F.col("at") > 0) & (F.trim(F.expr("substring(title, 3)")) == "")), "FND-013", "blank title", F.col("at"))
    stray = failure(rows.select("doc_id", F.explode("after").alias("x")), "FND-016", "text outside sections", F.col("x.line"))
    return all_failures(missing, blank, stray)


def severity_rule(docs: DataFrame) -> DataFrame:
    """FND-015 of findings (doc_id, tier, severity, cvss): a severity outside the band of the score; the inbox is exempt, bad vectors have no score."""
    scored = docs.where(F.col("tier") != "inbox").withColumn("__score", cvss_base_score(F.col("cvss"))).where("__score is not null")
    wrong = scored.where(~F.array_contains(severity_band(F.col("__score")), F.col("severity")))
    return failure(wrong, "FND-015", F.concat(F.col("severity"), F.lit(" for "), F.col("__score").cast("string")))


def frontmatter_rule(docs: DataFrame, rule_id: str) -> DataFrame:
    """FND-017 (findings) or WIKI-014 (pages): no fenced header in front, or a header line that is neither a field, an item, a comment nor a continuation."""
    split = frontmatter_split(docs)
    line = r"^(\s*#.*|\s*-(\s.*)?|[^\s:#][^:]*:(\s.*)?|\s+.*|)$"
    odd = F.exists(F.split("header", "\n"), lambda x: ~x.rlike(line))
    return failure(split.where(F.col("header").isNull() | odd), rule_id, F.when(F.col("header").isNull(), "missing").otherwise("not valid"))


def image_in_library_rule(line_rows: DataFrame, tiers: DataFrame) -> DataFrame:
    """REF-005: embeds of evidence in findings (doc_id, tier) of the library or the inbox."""
    found = references(line_rows).where((F.col("kind") == "embed") & F.col("ref_path").startswith("evidence/"))
    return failure(found.join(tiers.where(F.col("tier").isin("library", "inbox")).select("doc_id").distinct(), "doc_id", "left_semi"), "REF-005", F.col("ref_path"), F.col("line"))


def image_path_rule(line_rows: DataFrame, pages: DataFrame) -> DataFrame:
    """REF-007: images of pages (doc_id, path) that aren't under images/ at the book's root or ../images/ in a chapter."""
    chapter = F.size(F.split("path", "/")) > 4
    found = references(line_rows).where("kind = 'embed'").join(pages.select("doc_id", F.when(chapter, "../images/").otherwise("images/").alias("__prefix")), "doc_id")
    return failure(found.where(~F.col("ref_path").startswith(F.col("__prefix"))), "REF-007", F.concat("ref_path", F.lit(": expected "), "__prefix"), F.col("line"))


def place_rules(paths: DataFrame) -> DataFrame:
    """``rule_id, path``: WS-002 and WS-003, files under findings/ or methodology/ in no known place."""
    top = F.split("path", "/")[0]
    lost = paths.where(top.isin("findings", "methodology") & ~known_place(F.col("path")))
    return lost.select(F.when(top == "findings", "WS-002").otherwise("WS-003").alias("rule_id"), "path")


def segment_rule(paths: DataFrame) -> DataFrame:
    """``rule_id, path, message``: WS-001, every badly named segment of a path below findings/ or methodology/, a row each.

    Names with a leading dot are exempt, as is the name of a file right in evidence/ or images/, which has a rule of its own.
    """
    parts = F.split("path", "/")
    own = F.col("path").rlike("(^|/)(?:evidence|images)/[^/]+$")
    checked = F.when(own, F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    bad = F.filter(checked, lambda s: ~good_segment(s))
    found = paths.where(parts[0].isin("findings", "methodology")).select("path", F.explode(bad).alias("message"))
    return found.select(F.lit("WS-001").alias("rule_id"), "path", "message")


def file_set_rules(paths: DataFrame) -> DataFrame:
    """``rule_id, path, message`` of files right in evidence/ or images/: REF-008, a name that can't be one, and, in evidence/, REF-009, an extension that isn't taken."""
    own = F.regexp_extract("path", r"^(?:.*/)?(evidence|images)/[^/]+$", 1)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    rows = paths.select("path", own.alias("folder"), name.alias("name")).where("folder <> ''")
    bad = rows.select(F.lit("REF-008").alias("rule_id"), "path", file_name_problem(F.col("name")).alias("message"))
    odd = rows.where("folder = 'evidence'").select(F.lit("REF-009").alias("rule_id"), "path", extension_problem(F.col("name")).alias("message"))
    return bad.unionByName(odd).where("message is not null")


def generated_rule(files: DataFrame, fields: Sequence[str]) -> DataFrame:
    """``rule_id, path, message``: WS-010, generated files (path, text) that are no object, or lack or add a field."""
    keys = F.json_object_keys("text")
    wanted = F.array(*[F.lit(f) for f in fields])
    message = (
        F.when(keys.isNull(), "not an object").when(F.size(F.array_except(wanted, keys)) > 0, F.concat(F.lit("missing "), F.array_join(F.array_except(wanted, keys), ",")))
        .when(F.size(F.array_except(keys, wanted)) > 0, F.concat(F.lit("unknown "), F.array_join(F.array_except(keys, wanted), ",")))
    )
    return files.select(F.lit("WS-010").alias("rule_id"), "path", message.alias("message")).where("message is not null")


def note_rule(notes: DataFrame, index: DataFrame) -> DataFrame:
    """``rule_id, path, message``: REP-002, an indexed note (path, text) without frontmatter, or one that isn't indexed with it."""
    known = index.where("kind = 'note'").select("path").distinct().withColumn("__indexed", F.lit(True))
    rows = frontmatter_split(notes).join(known, "path", "left")
    message = F.when(F.col("__indexed") & F.col("header").isNull(), "indexed note without frontmatter").when(F.col("__indexed").isNull() & F.col("header").isNotNull(), "new note with frontmatter")
    return rows.select(F.lit("REP-002").alias("rule_id"), "path", message.alias("message")).where("message is not null")


def narrative_rule(files: DataFrame, order: DataFrame) -> DataFrame:
    """``rule_id, path, message``: REP-003, narrative files (report, field, path) whose field isn't in the report's order (report, field); a report without any is not checked."""
    checked = files.join(order.select("report").distinct(), "report", "left_semi")
    return checked.join(order.select("report", "field").distinct(), ["report", "field"], "left_anti").select(F.lit("REP-003").alias("rule_id"), "path", F.col("field").alias("message"))


def namespace(*tables: DataFrame) -> DataFrame:
    """The slugs (book, slug, and kind where the first table has it) of several namespaces, each once."""
    columns = [c for c in ("book", "kind", "slug") if c in tables[0].columns]
    return all_failures(*[t.select(*columns) for t in tables]).distinct()


def force_set(paths: DataFrame, forced: DataFrame, prefix: str) -> DataFrame:
    """``path, side``: what is forced (path, side) on known paths at or below ``prefix``, relative to it; a path forced to both sides raises no row."""
    below = forced.where((F.col("path") == prefix) | F.col("path").startswith(f"{prefix}/")).join(paths.select("path").distinct(), "path", "left_semi")
    one = below.groupBy("path").agg(F.min("side").alias("side"), F.count_distinct("side").alias("n")).where("n = 1")
    return one.select(F.expr(f"substring(path, {len(prefix) + 2})").alias("path"), "side")
