"""Registered queries of the library's own operators on the driver's tables, each beside its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from findlake.functions import scoring, text
from findlake.operators import documents, lookups, occurrences, reconcile

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL twin."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Occurrences: events, with the scan from the id, the user as check and the type as component.

OCC = """WITH occ AS (SELECT event_id AS pos, event_id % 7 AS scan_id, user_id AS key, event_type AS component,
 CAST(floor(value) AS BIGINT) % 5 AS sev_rank, CAST(json_extract_string(props, '$.k') AS BIGINT) AS qod, event_type, value FROM events)"""


def occ(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), (F.col("event_id") % 7).alias("scan_id"), F.col("user_id").alias("key"), F.col("event_type").alias("component"), (F.floor("value") % 5).alias("sev_rank"), k.alias("qod"), "event_type", "value")


@query(OCC + """, m AS (SELECT scan_id, key, component, max(sev_rank) r, min(pos) p, count(*) n FROM occ WHERE sev_rank >= 2 GROUP BY ALL)
SELECT scan_id, key, max(r) AS sev_rank, min(p) AS first_pos, CAST(sum(n) AS BIGINT) AS n_occurrences, string_agg(component, ',' ORDER BY p) AS components FROM m GROUP BY scan_id, key""")
def fil1_severity_filter(spark, sf_dir):
    kept = occurrences.severity_filter(occ(spark, sf_dir), "critical-medium")
    return occurrences.merge_occurrences(kept).withColumn("components", F.array_join("components", ","))


@query(OCC + " SELECT pos, key FROM occ WHERE key IN (1,2,3,5,8,13,21,34,55,89) AND key NOT IN (5,55)")
def fil2_plugin_filter(spark, sf_dir):
    return occurrences.plugin_filter(occ(spark, sf_dir), [1, 2, 3, 5, 8, 13, 21, 34, 55, 89], [5, 55]).select("pos", "key")


@query(OCC + " SELECT pos, qod FROM occ WHERE qod >= 50")
def fil3_min_confidence(spark, sf_dir):
    return occurrences.min_confidence(occ(spark, sf_dir), 50).select("pos", "qod")


@query(OCC + " SELECT pos FROM occ WHERE trim(CASE WHEN qod % 3 = 0 THEN 'later' WHEN qod % 3 = 1 THEN ' ' END) IS NULL OR trim(CASE WHEN qod % 3 = 0 THEN 'later' WHEN qod % 3 = 1 THEN ' ' END) = ''")
def fil4_drop_snoozed(spark, sf_dir):
    rows = occ(spark, sf_dir).withColumn("snoozed", F.when(F.col("qod") % 3 == 0, "later").when(F.col("qod") % 3 == 1, " "))
    return occurrences.drop_snoozed(rows).select("pos")


@query(OCC + """, m AS (SELECT scan_id, key, component, max(sev_rank) r, min(pos) p, count(*) n FROM occ GROUP BY ALL)
, f AS (SELECT scan_id, key, arg_min(value, pos) AS value FROM occ GROUP BY ALL)
SELECT m.scan_id, m.key, max(r) AS sev_rank, min(p) AS first_pos, CAST(sum(n) AS BIGINT) AS n_occurrences, string_agg(component, ',' ORDER BY p) AS components, any_value(f.value) AS value
FROM m JOIN f USING (scan_id, key) GROUP BY m.scan_id, m.key""")
def agg1_merge_occurrences(spark, sf_dir):
    return occurrences.merge_occurrences(occ(spark, sf_dir), first=["value"]).withColumn("components", F.array_join("components", ","))


CONFIDENCE = ["view", "click", "purchase"]


@query(OCC + """, r AS (SELECT key, event_type, list_position(['view','click','purchase'], event_type) AS k FROM occ)
SELECT key, 'confidence:' || arg_max(event_type, k) AS tag FROM r WHERE k > 0 GROUP BY key""")
def agg2_best_confidence(spark, sf_dir):
    return occurrences.best_confidence(occ(spark, sf_dir), CONFIDENCE, confidence="event_type")


@query(OCC + " SELECT key, arg_min(value, pos) AS value FROM occ GROUP BY key")
def agg3_first_flag(spark, sf_dir):
    return occurrences.first_flag(occ(spark, sf_dir), "value")


@query(OCC + " SELECT key, max(sev_rank) AS sev_rank, count(DISTINCT scan_id) AS n_scans, count(DISTINCT component) AS n_components, count(*) AS n_occurrences FROM occ GROUP BY key")
def agg4_cross_scan_rollup(spark, sf_dir):
    return occurrences.cross_scan_rollup(occ(spark, sf_dir))


@query("SELECT event_type AS scanner, CASE WHEN event_id % 5 = 0 THEN 'refused' ELSE 'ok' END AS status, count(*) AS n_files FROM events GROUP BY ROLLUP (event_type, CASE WHEN event_id % 5 = 0 THEN 'refused' ELSE 'ok' END)")
def agg5_parse_summary(spark, sf_dir):
    return occurrences.parse_summary(read(spark, sf_dir, "events").select(F.col("event_type").alias("scanner"), F.when(F.col("event_id") % 5 == 0, "refused").otherwise("ok").alias("status")))


@query(OCC + ", m AS (SELECT scan_id, key, max(sev_rank) AS sev_rank, min(pos) AS first_pos FROM occ GROUP BY ALL) SELECT scan_id, key, CAST(row_number() OVER (PARTITION BY scan_id ORDER BY sev_rank DESC, first_pos) AS INTEGER) AS place FROM m")
def win1_rank_findings(spark, sf_dir):
    return occurrences.rank_findings(occurrences.merge_occurrences(occ(spark, sf_dir))).select("scan_id", "key", F.col("place").cast("int").alias("place"))


@query(OCC + " SELECT key, pos, CAST(k AS INTEGER) AS place FROM (SELECT key, pos, row_number() OVER (PARTITION BY key ORDER BY pos) AS k FROM occ) WHERE k <= 20")
def win4_top_instances(spark, sf_dir):
    return occurrences.top_instances(occ(spark, sf_dir), ["key"], ["pos"]).select("key", "pos", "place")


SCANNERS = ["nessus", "burp", "zap", "acunetix", "openvas", "qualys", "sslyze"]


@query("SELECT event_id, CASE WHEN user_id % 7 IN (1, 2, 3) THEN 'web' ELSE 'network' END AS finding_type FROM events")
def fil7_default_finding_type(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", occurrences.default_finding_type(F.element_at(F.array(*[F.lit(x) for x in SCANNERS]), (F.col("user_id") % 7 + 1).cast("int"))).alias("finding_type"))


@query("""SELECT p_partkey AS key, trim(p_name) AS title, list_extract(['informational','low','medium','high','critical'], CAST(p_partkey % 5 + 1 AS INTEGER)) AS severity,
 CASE WHEN p_partkey % 2 = 0 THEN 'web' ELSE 'network' END AS finding_type, p_brand || chr(10) || p_type AS affected_entities, CASE WHEN p_size <= 40 THEN p_size END AS cwe,
 concat_ws('; ', CASE WHEN p_partkey % 3 = 0 THEN 'cvss: version' END, CASE WHEN p_size > 40 THEN 'cwe: unknown ' || p_size END) AS warnings FROM part""")
def fil6_map_to_finding(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    merged = part.select(F.col("p_partkey").alias("key"), F.col("p_name").alias("title"), (F.col("p_partkey") % 5).alias("sev_rank"), F.array("p_brand", "p_type").alias("components"), F.col("p_size").alias("cwe"), F.when(F.col("p_partkey") % 3 == 0, "version").alias("cvss_error"), F.when(F.col("p_partkey") % 2 == 0, "zap").otherwise("nessus").alias("scanner"))
    names = part.where("p_size <= 40").select(F.col("p_size").alias("cwe_id")).distinct().withColumn("name", F.lit("known"))
    return occurrences.map_to_finding(merged, names)


# Scores: vectors from part keys.

VEC = """WITH v AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '3.1' ELSE '3.0' END AS ver, substr('NALP', CAST(p_partkey % 4 AS INT) + 1, 1) AS av, substr('LH', CAST(p_partkey // 4 % 2 AS INT) + 1, 1) AS ac, substr('NLH', CAST(p_partkey // 8 % 3 AS INT) + 1, 1) AS pr,
 substr('NR', CAST(p_partkey // 24 % 2 AS INT) + 1, 1) AS ui, substr('UC', CAST(p_partkey // 48 % 2 AS INT) + 1, 1) AS s, substr('NLH', CAST(p_partkey // 96 % 3 AS INT) + 1, 1) AS c, substr('NLH', CAST(p_partkey // 288 % 3 AS INT) + 1, 1) AS i, substr('NLH', CAST(p_partkey // 5 % 3 AS INT) + 1, 1) AS a FROM part)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    pick = lambda letters, by: F.substring(F.lit(letters), 1, 100).substr((F.floor(k / by) % len(letters) + 1).cast("int"), F.lit(1))
    parts = [("AV", "NALP", 1), ("AC", "LH", 4), ("PR", "NLH", 8), ("UI", "NR", 24), ("S", "UC", 48), ("C", "NLH", 96), ("I", "NLH", 288), ("A", "NLH", 5)]
    vector = F.concat(F.lit("CVSS:"), F.when(k % 2 == 0, "3.1").otherwise("3.0"), *[F.concat(F.lit(f"/{m}:"), pick(letters, by)) for m, letters, by in parts])
    return read(spark, sf_dir, "part").select("p_partkey", vector.alias("vector"))


@query("""SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN 'no prefix' WHEN 1 THEN 'version' WHEN 2 THEN 'empty segment' WHEN 3 THEN 'no colon' WHEN 4 THEN 'duplicate metric' WHEN 5 THEN 'unknown metric' WHEN 6 THEN 'illegal value' WHEN 7 THEN 'missing metric' END AS error FROM part""")
def sca1_cvss_parse(spark, sf_dir):
    k, v = F.col("p_partkey") % 9, F.col("vector")
    broken = F.when(k == 0, F.substring(v, 6, 200)).when(k == 1, F.regexp_replace(v, r"^CVSS:3\.\d", "CVSS:4.0")).when(k == 2, F.concat(v, F.lit("/"))).when(k == 3, F.concat(v, F.lit("/E"))).when(k == 4, F.concat(v, F.lit("/AV:N"))).when(k == 5, F.concat(v, F.lit("/ZZ:N"))).when(k == 6, F.regexp_replace(v, "/AC:.", "/AC:Q")).when(k == 7, F.regexp_replace(v, "/AC:.", "")).otherwise(v)
    return vectors(spark, sf_dir).select("p_partkey", scoring.cvss_parse(broken)["error"].alias("error"))


@query(VEC + """, w AS (SELECT p_partkey, ver, s, CASE av WHEN 'N' THEN 0.85 WHEN 'A' THEN 0.62 WHEN 'L' THEN 0.55 ELSE 0.2 END::DOUBLE * (CASE ac WHEN 'L' THEN 0.77 ELSE 0.44 END)::DOUBLE AS x1,
 (CASE WHEN pr = 'N' THEN 0.85 WHEN pr = 'L' THEN CASE s WHEN 'C' THEN 0.68 ELSE 0.62 END ELSE CASE s WHEN 'C' THEN 0.5 ELSE 0.27 END END)::DOUBLE AS pw, (CASE ui WHEN 'N' THEN 0.85 ELSE 0.62 END)::DOUBLE AS uw,
 1 - (1 - (CASE c WHEN 'N' THEN 0 WHEN 'L' THEN 0.22 ELSE 0.56 END)::DOUBLE) * (1 - (CASE i WHEN 'N' THEN 0 WHEN 'L' THEN 0.22 ELSE 0.56 END)::DOUBLE) * (1 - (CASE a WHEN 'N' THEN 0 WHEN 'L' THEN 0.22 ELSE 0.56 END)::DOUBLE) AS iss FROM v)
, x AS (SELECT *, CASE s WHEN 'C' THEN 7.52::DOUBLE * (iss - 0.029::DOUBLE) - 3.25::DOUBLE * power(iss - 0.02::DOUBLE, 15.0::DOUBLE) ELSE 6.42::DOUBLE * iss END AS impact FROM w)
, y AS (SELECT *, least(10.0::DOUBLE, CASE s WHEN 'C' THEN 1.08::DOUBLE * (impact + 8.22::DOUBLE * x1 * pw * uw) ELSE impact + 8.22::DOUBLE * x1 * pw * uw END) AS raw FROM x)
SELECT p_partkey, CAST(CASE WHEN impact <= 0 THEN 0 WHEN ver = '3.1' THEN CASE WHEN CAST(round_even(raw * 100000, 0) AS BIGINT) % 10000 = 0 THEN round_even(raw * 100000, 0) / 100000 ELSE (floor(round_even(raw * 100000, 0) / 10000) + 1) / 10 END ELSE round(raw + 1e-9::DOUBLE, 1) END AS DOUBLE) AS score FROM y""")
def sca2_cvss_base_score(spark, sf_dir):
    return vectors(spark, sf_dir).select("p_partkey", scoring.cvss_base_score(F.col("vector")).alias("score"))


@query("""SELECT p_partkey, 'CVSS:3.1/AV:' || substr('NAL', CAST(p_partkey % 3 AS INT) + 1, 1) || '/AC:' || substr('LHH', CAST(p_partkey % 3 AS INT) + 1, 1) || '/PR:' || substr('NLH', CAST(p_partkey % 3 AS INT) + 1, 1) || '/UI:N/S:U/C:' || substr('NLH', CAST(p_partkey % 3 AS INT) + 1, 1) || '/I:N/A:H' AS vector FROM part""")
def sca3_cvss2_to_3(spark, sf_dir):
    k = (F.col("p_partkey") % 3 + 1).cast("int")
    one = lambda letters: F.lit(letters).substr(k, F.lit(1))
    v2 = F.concat(F.lit("CVSS2#(AV:"), one("NAL"), F.lit("/AC:"), one("LMH"), F.lit("/Au:"), one("NSM"), F.lit("/C:"), one("NPC"), F.lit("/I:N/A:C)"))
    return read(spark, sf_dir, "part").select("p_partkey", scoring.cvss2_to_3(v2).alias("vector"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'CVSS:3.1/AV:N' WHEN 1 THEN 'CVSS:3.0/AV:N' WHEN 2 THEN '' ELSE 'CVSS:3.0/CVSS:2.0/AV:N' END AS vector FROM part")
def sca4_ensure_prefix(spark, sf_dir):
    k = F.col("p_partkey") % 4
    return read(spark, sf_dir, "part").select("p_partkey", scoring.ensure_cvss3_prefix(F.when(k == 0, "CVSS:3.1/AV:N").when(k == 1, " AV:N").when(k == 2, " ").otherwise("CVSS:2.0/AV:N")).alias("vector"))


@query("""SELECT p_partkey, CASE WHEN s <= 0 THEN 'informational' WHEN s <= 3.9 THEN 'low' WHEN s <= 6.9 THEN 'medium' WHEN s <= 8.9 THEN 'high' ELSE 'critical' END AS severity,
 CASE WHEN s <= 0 THEN 'informational,low' WHEN s < 4 THEN 'low' WHEN s < 7 THEN 'medium' WHEN s < 9 THEN 'high' ELSE 'critical' END AS band FROM (SELECT p_partkey, CAST(p_partkey % 101 AS DOUBLE) / 10 AS s FROM part)""")
def sca5_sca6_score_bands(spark, sf_dir):
    s = (F.col("p_partkey") % 101).cast("double") / 10
    return read(spark, sf_dir, "part").select("p_partkey", scoring.score_to_severity(s).alias("severity"), F.array_join(scoring.severity_band(s), ",").alias("band"))


@query("""WITH o AS (SELECT o_orderkey, lower(regexp_extract(o_orderpriority, '[A-Z]+')) AS w FROM orders), n AS (SELECT o_orderkey, CASE WHEN w IN ('low','medium','high','critical') THEN w ELSE 'informational' END AS severity FROM o)
SELECT o_orderkey, severity, CAST(list_position(['informational','low','medium','high','critical'], severity) AS INTEGER) AS remote FROM n""")
def sca7_sca8_severity_words(spark, sf_dir):
    name = scoring.severity_name(F.regexp_extract("o_orderpriority", "[A-Z]+", 0))
    return read(spark, sf_dir, "orders").select("o_orderkey", name.alias("severity"), scoring.remote_id(name).alias("remote"))


@query("SELECT p_partkey, CASE WHEN p_size > 0 THEN 'CWE-' || p_size ELSE '' END AS cwe FROM part")
def sca9_cwe_normalize(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", scoring.cwe_label(F.concat(F.lit("cwe-0"), F.col("p_size").cast("string"))).alias("cwe"))


@query("SELECT p_partkey, regexp_replace(regexp_replace(lower(trim(p_name || ' (' || p_brand || ')')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, trim(regexp_replace('  ' || p_name || chr(9) || p_type || ' ', '\\s+', ' ', 'g')) AS flat FROM part")
def sca10_sca11_slugs(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    return p.select("p_partkey", text.slugify(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))).alias("slug"), text.collapse_whitespace(F.concat(F.lit("  "), "p_name", F.lit("\t"), "p_type", F.lit(" "))).alias("flat"))


@query("""WITH p AS (SELECT page_id, replace(url, '&', '&amp;') AS u FROM pages)
SELECT page_id, CASE page_id % 5 WHEN 0 THEN '' WHEN 1 THEN '<ul><li><a href="' || u || '">' || u || '</a></li><li>plain &lt;note&gt; ' || page_id || '</li></ul>'
 WHEN 2 THEN '<ul><li><a href="' || u || '">it&#x27;s &quot;' || page_id || '&quot;</a></li></ul>' WHEN 3 THEN '<ul><li><a href="/wiki/' || page_id || '">page</a></li></ul>' ELSE '<ul><li><a href="' || u || '">' || u || '</a></li></ul>' END AS html FROM p""")
def sca12_refs_to_html(spark, sf_dir):
    k, key, none = F.col("page_id") % 5, F.col("page_id").cast("string"), F.lit(None).cast("string")
    ref = lambda label, url: F.struct(label.alias("text"), url.alias("url"))
    refs = (
        F.when(k == 1, F.array(ref(none, F.col("url")), ref(F.concat(F.lit("plain <note> "), key), none))).when(k == 2, F.array(ref(F.concat(F.lit(" it's \""), key, F.lit('"')), F.col("url"))))
        .when(k == 3, F.array(ref(F.lit("page"), F.concat(F.lit("/wiki/"), key)))).when(k == 4, F.array(ref(F.lit("  "), F.col("url")))).otherwise(F.array().cast("array<struct<text:string,url:string>>"))
    )
    return read(spark, sf_dir, "pages").select("page_id", text.refs_to_html(refs).alias("html"))


@query()
def sca13_html_to_text(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", text.html_to_text(F.col("html")).alias("text"))


MARKED = "replace(text, ' ', CASE doc_id % 7 WHEN 0 THEN '{{' WHEN 1 THEN '}}' WHEN 2 THEN '{%' WHEN 3 THEN '%}' WHEN 4 THEN '{#' WHEN 5 THEN '#}' ELSE ' ' END)"


@query(r"SELECT doc_id, md5(regexp_replace(" + MARKED + r", '(\{\{|\}\}|\{%|%\}|\{#|#\})', '{{ ''\1'' }}', 'g')) AS escaped, CASE WHEN text IS NOT NULL THEN TRUE END AS same FROM documents")
def sca14_template_escape(spark, sf_dir):
    marked = F.expr(MARKED)
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(text.template_escape(marked)).alias("escaped"), (text.template_unescape(text.template_escape(marked)) == marked).alias("same"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'empty tag' WHEN p_partkey % 4 = 1 THEN 'space around tag' WHEN p_partkey % 4 = 2 THEN 'repeated tag' END AS problem, substr(p_brand, 1, 1) || repeat('*', length(p_brand) - 1) AS masked FROM part")
def sca15_sca16_tags_and_masks(spark, sf_dir):
    k = F.col("p_partkey") % 4
    tags = F.when(k == 0, F.array(F.lit("a"), F.lit(""))).when(k == 1, F.array(F.lit(" a"))).when(k == 2, F.array(F.lit("a"), F.lit("A"))).otherwise(F.array(F.lit("a"), F.lit("b")))
    return read(spark, sf_dir, "part").select("p_partkey", text.tags_problem(tags).alias("problem"), text.mask_term(F.col("p_brand")).alias("masked"))


@query("SELECT p_partkey, regexp_matches(p_name, '^[a-z0-9][a-z0-9._-]*$') AS good, CASE p_partkey % 6 WHEN 0 THEN 'use png' WHEN 1 THEN 'not allowed' WHEN 3 THEN 'use txt' WHEN 4 THEN 'not allowed' WHEN 5 THEN 'use txt' END AS hint FROM part")
def sca17_sca18_names(spark, sf_dir):
    k = F.col("p_partkey") % 6
    name = F.concat(F.lit("file."), F.when(k == 0, "GIF").when(k == 1, "exe").when(k == 3, "htm").when(k == 4, "json").when(k == 5, "csv").otherwise("md"))
    return read(spark, sf_dir, "part").select("p_partkey", text.good_segment(F.col("p_name")).alias("good"), text.extension_problem(name).alias("hint"))


@query("SELECT page_id, url || '/a b+c' AS path, CASE WHEN page_id % 2 = 0 THEN CAST(page_id AS VARCHAR) ELSE 'x' END AS token, page_id * 100000 + 7 AS composite FROM pages")
def sca19_sca20_sca21_ids(spark, sf_dir):
    k = F.col("page_id")
    return read(spark, sf_dir, "pages").select("page_id", text.decode_ref_path(F.concat("url", F.lit("/a%20b+c"))).alias("path"), text.gallery_token(F.when(k % 2 == 0, F.concat(F.lit("/g/"), k.cast("string"), F.lit("/p.png"))).otherwise("x")).alias("token"), text.composite_id(k, F.lit(7)).alias("composite"))


# Documents

LINES = "WITH u AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS line, len(string_split(text, chr(10))) AS n FROM documents), l AS (SELECT * FROM u WHERE NOT (line = n AND content = ''))"


@query(LINES + " SELECT doc_id, CAST(line AS INTEGER) AS line, md5(content) AS digest FROM l")
def doc1_lines(spark, sf_dir):
    return documents.explode_lines(read(spark, sf_dir, "documents")).select("doc_id", "line", F.md5("content").alias("digest"))


def marked_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents under a Markdown frame that varies with the id."""
    k = F.col("doc_id") % 4
    body = F.concat(
        F.lit("# T"), F.col("doc_id").cast("string"), F.lit("\n\n## Impact\n"), F.col("source"), F.lit("\n```\n## not a heading\n```\n"), F.when(k == 0, "## Impact\nagain\n").when(k == 1, "#### deep\n").when(k == 2, "## Extra\n![cap](evidence/a.png)\n").otherwise("see [x](evidence/b.md) here\n"), F.lit("## Description\n"), F.coalesce("text", F.lit("")),
    )
    return read(spark, sf_dir, "documents").select("doc_id", body.alias("text"))


@query("""SELECT doc_id, 'FND-009' AS rule_id, CAST(NULL AS INTEGER) AS line, 'Mitigation' AS message FROM documents
UNION ALL SELECT doc_id, 'FND-011', 8, 'Impact' FROM documents WHERE doc_id % 4 = 0 UNION ALL SELECT doc_id, 'FND-010', 8, 'Extra' FROM documents WHERE doc_id % 4 = 2
UNION ALL SELECT doc_id, 'FND-010', 6, 'not a heading' FROM documents UNION ALL SELECT doc_id, 'FND-012', CAST(CASE WHEN doc_id % 4 = 0 THEN 10 WHEN doc_id % 4 = 2 THEN 10 ELSE 9 END AS INTEGER), 'Description' FROM documents""")
def fnd009_012_sections(spark, sf_dir):
    docs = marked_docs(spark, sf_dir)
    return documents.section_rules(documents.sections(docs), docs, ["Description", "Impact", "Mitigation"])


@query("SELECT doc_id, 'WIKI-012' AS rule_id, CAST(8 AS INTEGER) AS line, 'level 2 to 4' AS message FROM documents WHERE doc_id % 4 = 1 UNION ALL SELECT doc_id, 'WIKI-013', 1, 'heading repeats the title' FROM documents WHERE doc_id % 5 = 0")
def win6_heading_rules(spark, sf_dir):
    docs = marked_docs(spark, sf_dir)
    titles = docs.select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("T"), F.col("doc_id").cast("string"))).otherwise("other").alias("title"))
    return documents.heading_rules(documents.headings(documents.explode_lines(docs, fences=True)), titles)


@query("""SELECT doc_id, 'REF-006' AS rule_id, CAST(8 AS INTEGER) AS line, 'evidence/b' || doc_id || '.md' AS message FROM documents WHERE doc_id % 4 = 3 AND doc_id % 3 <> 0
UNION ALL SELECT doc_id, 'REF-002', 9, 'evidence/a' || doc_id || '.png' FROM documents WHERE doc_id % 4 = 2 AND doc_id % 5 <> 0 UNION ALL SELECT doc_id, 'REF-001', 8, 'evidence/c.png' FROM documents WHERE doc_id % 4 = 0
UNION ALL SELECT doc_id, 'REF-002', 8, 'evidence/c.png' FROM documents WHERE doc_id % 4 = 0""")
def doc4_reference_rules(spark, sf_dir):
    k, key = F.col("doc_id") % 4, F.col("doc_id").cast("string")
    body = F.concat(
        F.lit("# T\n\n## Impact\nx\n```\n![no](evidence/no.png)\n```\n"),
        F.when(k == 0, "see ![c](evidence/c.png) here\n").when(k == 2, F.concat(F.lit("two\n![cap](evidence/a"), key, F.lit(".png)\n"))).when(k == 3, F.concat(F.lit("see [x](evidence/b"), key, F.lit(".md) here\n"))).otherwise("`![no](evidence/no.png)`\n"),
    )
    docs = read(spark, sf_dir, "documents")
    there = docs.where("doc_id % 4 = 3 and doc_id % 3 = 0").select(F.concat(F.lit("evidence/b"), key, F.lit(".md")).alias("ref_path"))
    files = there.unionByName(docs.where("doc_id % 5 = 0").select(F.concat(F.lit("evidence/a"), key, F.lit(".png")).alias("ref_path")))
    return documents.reference_rules(documents.references(documents.explode_lines(docs.select("doc_id", F.concat(body, F.coalesce("text", F.lit(""))).alias("text")), fences=True)), files)


@query("WITH u AS (SELECT page_id AS doc_id, unnest(regexp_extract_all(html, '(?i)href=\"([^\"]*)\"', 1)) AS url FROM pages) SELECT doc_id, url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme FROM u")
def doc5_links(spark, sf_dir):
    return documents.links(read(spark, sf_dir, "pages"), "page_id", "html")


@query("WITH u AS (SELECT page_id AS doc_id, lower(unnest(regexp_extract_all(html, '<([A-Za-z][A-Za-z0-9]*)', 1))) AS tag FROM pages) SELECT doc_id, tag, count(*) AS n FROM u GROUP BY ALL")
def doc7_html_tags(spark, sf_dir):
    return documents.html_tags(read(spark, sf_dir, "pages"), "page_id", "html").groupBy("doc_id", "tag").agg(F.count("*").alias("n"))


@query(LINES + """ SELECT doc_id, CAST(line AS INTEGER) AS line, 'of the' AS phrase FROM l WHERE regexp_matches(content, '(?i)(^|[^\\p{L}\\p{N}_])of\\s+the($|[^\\p{L}\\p{N}_])')
UNION ALL SELECT doc_id, CAST(line AS INTEGER), 'que la' FROM l WHERE regexp_matches(content, '(?i)(^|[^\\p{L}\\p{N}_])que\\s+la($|[^\\p{L}\\p{N}_])')""")
def doc8_scan_phrases(spark, sf_dir):
    return documents.scan_phrases(documents.explode_lines(read(spark, sf_dir, "documents")), ["of the", "que la"])


@query(LINES + " SELECT doc_id, CAST(line AS INTEGER) AS line, 't***' AS masked FROM l WHERE regexp_matches(content, '(?i)(^|[^\\p{L}\\p{N}_])that($|[^\\p{L}\\p{N}_])') AND source <> 'src1'")
def doc9_scan_terms(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    rows = documents.explode_lines(docs.withColumn("path", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"))), more=["path"])
    return documents.scan_terms(rows, [("that", "src1")])


@query("""WITH d AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'WIKI-009' WHEN 1 THEN 'WIKI-010' END AS rule_id FROM documents)
SELECT rule_id, count(*) AS n_failures, count(*) AS n_docs FROM (SELECT rule_id FROM d WHERE rule_id IS NOT NULL UNION ALL SELECT 'WIKI-011' FROM documents WHERE doc_id % 2 = 0) GROUP BY rule_id""")
def agg16_rule_summary(spark, sf_dir):
    k = F.col("doc_id")
    docs = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.when(k % 3 == 0, "a\r\n").when(k % 3 == 1, "a \n").otherwise("a\n"), F.lit("b"), F.when(k % 2 == 0, "").otherwise("\n")).alias("text"))
    return documents.rule_summary(documents.line_hygiene(docs))


# Reconciliation: orders as the last synced records, with edits on both sides.

SLOTS = """WITH s AS (SELECT o_orderkey AS id, 'p/' || o_orderkey AS path, o_orderpriority AS kind, CASE o_orderstatus WHEN 'O' THEN 'read-write' WHEN 'F' THEN 'read-only' ELSE 'append-only' END AS mode, TRUE AS indexed,
 CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN CASE WHEN o_orderkey % 35 = 0 AND o_orderkey % 2 = 0 THEN 'b' ELSE 'l' END ELSE 'o' END AS l,
 CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN CASE WHEN o_orderkey % 35 = 0 AND o_orderkey % 2 = 0 THEN 'b' ELSE 'r' END ELSE 'o' END AS r, CASE WHEN o_orderkey % 17 <> 0 THEN 'o' END AS b FROM orders),
k AS (SELECT *, CASE WHEN l IS NOT NULL AND r IS NOT NULL THEN CASE WHEN l = r THEN CASE WHEN b IS NOT NULL AND b <> l THEN 'REPAIR' ELSE 'CLEAN' END WHEN b IS NULL THEN 'COLLISION' WHEN r = b THEN 'PUSH' WHEN l = b THEN 'PULL' ELSE 'COLLISION' END
 WHEN l IS NOT NULL THEN CASE WHEN l = b THEN 'DELETE_LOCAL' ELSE 'COLLISION' END WHEN r IS NOT NULL THEN CASE WHEN r = b THEN 'DELETE_REMOTE' ELSE 'COLLISION' END ELSE 'FORGET' END AS o0 FROM s),
c AS (SELECT *, CASE WHEN mode <> 'read-write' AND o0 IN ('PUSH','CREATE','DELETE_REMOTE','COLLISION') THEN 'INVALID' ELSE o0 END AS o1 FROM k)"""


def slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    both = (k % 35 == 0) & (k % 2 == 0)
    local = F.when(k % 11 == 0, None).when(k % 7 == 0, F.when(both, "b").otherwise("l")).otherwise("o")
    remote = F.when(k % 13 == 0, None).when(k % 5 == 0, F.when(both, "b").otherwise("r")).otherwise("o")
    mode = F.when(F.col("o_orderstatus") == "O", "read-write").when(F.col("o_orderstatus") == "F", "read-only").otherwise("append-only")
    return read(spark, sf_dir, "orders").select(k.alias("id"), F.concat(F.lit("p/"), k.cast("string")).alias("path"), F.col("o_orderpriority").alias("kind"), mode.alias("mode"), F.lit(True).alias("indexed"), local.alias("local_hash"), remote.alias("remote_hash"), F.when(k % 17 != 0, "o").alias("base_hash"))


@query(SLOTS + " SELECT id, o1 AS outcome FROM c")
def rec3_rec4_classify(spark, sf_dir):
    return reconcile.classify(slots(spark, sf_dir)).select("id", "outcome")


FORCED = SLOTS + """, f AS (SELECT *, CASE WHEN id % 3 = 0 THEN 'local' WHEN id % 3 = 1 THEN 'remote' END AS side FROM c),
g AS (SELECT *, CASE WHEN o1 = 'COLLISION' AND side = 'local' THEN CASE WHEN l IS NULL THEN 'DELETE_REMOTE' ELSE 'PUSH' END WHEN o1 = 'COLLISION' AND side = 'remote' THEN CASE WHEN r IS NULL THEN 'DELETE_LOCAL' ELSE 'PULL' END
 WHEN o1 = 'DELETE_REMOTE' AND side = 'remote' THEN 'PULL' WHEN o1 = 'DELETE_LOCAL' AND side = 'local' AND mode = 'read-write' THEN 'CREATE' END AS o2 FROM f), h AS (SELECT *, coalesce(o2, o1) AS o3, o2 IS NOT NULL AS forced FROM g)"""


def force(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slots(spark, sf_dir).select("path", F.when(F.col("id") % 3 == 0, "local").when(F.col("id") % 3 == 1, "remote").alias("side")).where("side is not null")


@query(FORCED + " SELECT id, o3 AS outcome, forced FROM h")
def rec5_force(spark, sf_dir):
    return reconcile.apply_force(reconcile.classify(slots(spark, sf_dir)), force(spark, sf_dir)).select("id", "outcome", "forced")


GATED = FORCED + """, v AS (SELECT *, CASE WHEN o3 IN ('PUSH','CREATE','DELETE_REMOTE','MOVE_EDIT') AND id % 19 = 0 THEN 'INVALID' ELSE o3 END AS o4 FROM h),
t AS (SELECT *, CASE WHEN o4 IN ('CLEAN','REPAIR','FORGET','INVALID') THEN NULL WHEN id % 23 = 0 THEN 'recycled' WHEN id % 29 = 0 THEN 'editor' WHEN id % 31 = 0 THEN 'draft or template' END AS reason FROM v), z AS (SELECT *, CASE WHEN reason IS NOT NULL THEN 'SKIP' ELSE o4 END AS o5 FROM t),
q AS (SELECT kind, sum(CASE WHEN forced THEN 0 WHEN o5 = 'DELETE_REMOTE' THEN 2 WHEN o5 IN ('PUSH','CREATE','MOVE_EDIT') THEN 1 ELSE 0 END) AS w, sum(CASE WHEN forced THEN 0 WHEN o5 = 'DELETE_LOCAL' THEN 2 WHEN o5 = 'PULL' THEN 1 ELSE 0 END) AS d, count(*) AS n FROM z GROUP BY kind),
e AS (SELECT z.*, CASE WHEN NOT forced AND ((w > 5 AND w > 0.2 * n AND o5 IN ('PUSH','CREATE','DELETE_REMOTE','MOVE_EDIT')) OR (d > 5 AND d > 0.2 * n AND o5 IN ('PULL','DELETE_LOCAL'))) THEN 'WITHHELD' ELSE o5 END AS outcome FROM z JOIN q USING (kind))"""


def reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("id")
    rows = slots(spark, sf_dir).withColumns({"recycled": k % 23 == 0, "editor": F.when(k % 29 == 0, "wysiwyg").otherwise("markdown"), "draft": k % 31 == 0, "template": F.lit(False)})
    failures = slots(spark, sf_dir).where("id % 19 = 0").select("path", F.lit("FND-003").alias("rule_id"))
    return reconcile.reconcile(rows, failures, force(spark, sf_dir))


@query(GATED + " SELECT id, outcome, reason FROM e")
def rec6_rec9_reconcile(spark, sf_dir):
    return reconciled(spark, sf_dir).select("id", "outcome", "reason")


@query(GATED + " SELECT kind, count(*) FILTER (outcome = 'CLEAN') AS CLEAN, count(*) FILTER (outcome = 'PULL') AS PULL, count(*) FILTER (outcome = 'INVALID') AS INVALID, count(*) FILTER (outcome = 'WITHHELD') AS WITHHELD FROM e GROUP BY kind")
def agg6_kind_summary(spark, sf_dir):
    return lookups.kind_summary(reconciled(spark, sf_dir), ["CLEAN", "PULL", "INVALID", "WITHHELD"])


@query(GATED + """ SELECT id, CASE WHEN outcome = 'PULL' THEN r ELSE l END AS local_hash, CASE WHEN outcome IN ('PUSH','CREATE') THEN l ELSE r END AS remote_hash,
 CASE WHEN outcome IN ('CLEAN','REPAIR','PUSH','PULL','CREATE') THEN CASE WHEN outcome = 'PULL' THEN r ELSE l END ELSE b END AS base_hash FROM e WHERE outcome NOT IN ('DELETE_LOCAL','DELETE_REMOTE','FORGET')""")
def rec10_apply_plan(spark, sf_dir):
    return reconcile.apply_plan(reconciled(spark, sf_dir)).select("id", "local_hash", "remote_hash", "base_hash")


@query(SLOTS + " SELECT kind, id, CASE WHEN o1 = 'DELETE_REMOTE' THEN 'recreate' WHEN id % 3 = 0 THEN 'report' ELSE 'write back' END AS action, CASE WHEN o1 = 'DELETE_REMOTE' OR id % 3 <> 0 THEN r END AS content FROM c WHERE o1 IN ('PUSH','DELETE_REMOTE')")
def log1_log2_restore(spark, sf_dir):
    plan = reconcile.classify(slots(spark, sf_dir))
    log = lookups.record_changes(plan, "run-1")
    now = plan.where("outcome = 'PUSH'").select("kind", "id", F.when(F.col("id") % 3 == 0, "changed").otherwise(F.col("local_hash")).alias("now_hash"))
    return lookups.restore_run(log, now)


# Lookups and rollups


@query("WITH a AS (SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0), b AS (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0) SELECT coalesce(a.o_orderkey, b.o_orderkey) AS path, CASE WHEN a.o_orderkey IS NULL THEN 'missing' WHEN b.o_orderkey IS NULL THEN 'unindexed' ELSE 'present' END AS state FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey")
def joi2_set2_partition_present(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"))
    return reconcile.partition_present(o.where("path % 2 = 0"), o.where("path % 3 = 0"))


@query("SELECT l_orderkey, l_partkey, coalesce(p_name, 'QID unknown') AS title, coalesce(p_size, 3) AS severity FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_partkey % 5 <> 0) ON l_partkey = p_partkey")
def joi1_glossary_join(spark, sf_dir):
    glossary = read(spark, sf_dir, "part").where("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("title"), F.col("p_size").alias("severity"), F.col("p_partkey").alias("pos"))
    return lookups.glossary_join(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey"), glossary, "l_partkey", "pos", {"title": "QID unknown", "severity": 3})


@query("SELECT c_custkey AS page_id, CAST(CASE WHEN c_custkey % 2 = 0 THEN c_nationkey ELSE n_regionkey END AS INTEGER) AS book_id FROM customer JOIN nation ON c_nationkey = n_nationkey")
def joi7_book_members(spark, sf_dir):
    pages = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("page_id"), F.col("c_nationkey").alias("chapter_id"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey")).alias("book_id"))
    return lookups.book_members(pages, read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("book_id")))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN 'recoverable' ELSE 'gone' END AS state FROM part WHERE p_partkey % 2 = 0")
def joi8_recycled(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    return lookups.recycled_awareness(p, p.where("id % 2 = 1"), p.where("id % 4 = 0"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def joi9_scope_tripwire(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus")
    return lookups.scope_tripwire(read(spark, sf_dir, "customer").select("c_custkey"), o, o.where("o_orderstatus = 'P'"), "c_custkey")


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN 'missing' WHEN p_partkey % 7 = 0 THEN 'unknown' ELSE 'renamed' END AS problem FROM part WHERE (p_partkey % 5 = 0) <> (p_partkey % 7 = 0) OR (p_partkey % 5 <> 0 AND p_partkey % 11 = 0)")
def joi10_lookup_drift(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return reconcile.lookup_drift(p.where("id % 5 <> 0").withColumn("name", F.when(F.col("id") % 11 == 0, "new").otherwise(F.col("name"))), p.where("id % 7 <> 0"))


@query("""WITH s AS (SELECT *, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_brand END AS key, regexp_replace(regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS a, substr(sha256(CAST(p_partkey AS VARCHAR)), 1, 8) AS h FROM part),
t AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY a) = 1 THEN a WHEN key = '' THEN a || '-' || h ELSE a || '-' || regexp_replace(regexp_replace(lower(trim(key)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') END AS st FROM s)
SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY st) > 1 THEN st || '-' || h ELSE st END AS stem FROM t""")
def win2_file_stems(spark, sf_dir):
    part = read(spark, sf_dir, "part").withColumn("key", F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.col("p_brand")))
    return lookups.file_stems(part, "p_name", "key", "p_partkey").select("p_partkey", "stem")


@query("SELECT p_partkey, CASE WHEN k = 1 THEN p_name ELSE p_name || '-' || k END AS unique_name FROM (SELECT *, row_number() OVER (PARTITION BY p_type, p_name ORDER BY p_partkey) AS k FROM part)")
def win3_dedupe_names(spark, sf_dir):
    return lookups.dedupe_names(read(spark, sf_dir, "part"), "p_type", "p_name", "p_partkey").select("p_partkey", "unique_name")


@query("SELECT o_orderkey FROM (SELECT o_orderkey, dense_rank() OVER (ORDER BY CAST(o_orderdate AS DATE) DESC) AS k FROM orders) WHERE k <= 10")
def win5_keep_newest(spark, sf_dir):
    return lookups.keep_newest(read(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("run_id"))).select("o_orderkey")


@query("SELECT p_type AS folder, p_name AS name, CASE WHEN count(DISTINCT p_brand) = 1 THEN min(p_brand) END AS caption, count(DISTINCT p_brand) AS n_captions, CASE WHEN count(DISTINCT p_brand) > 1 THEN 'conflict' END AS problem FROM part GROUP BY ALL")
def agg8_ref004_caption_opinions(spark, sf_dir):
    return lookups.caption_opinions(read(spark, sf_dir, "part").select(F.col("p_type").alias("folder"), F.col("p_name").alias("name"), F.col("p_brand").alias("caption"), F.col("p_partkey").alias("pos")))


@query("SELECT p_type AS folder, p_partkey, n FROM (SELECT *, count(*) OVER (PARTITION BY p_type, p_name) AS n FROM part) WHERE n > 1")
def agg9_ref003_stem_groups(spark, sf_dir):
    files = read(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("folder"), F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, ".png").otherwise(".md")).alias("name"))
    return lookups.stem_groups(files).select("folder", "p_partkey", "n")


@query("SELECT o_orderstatus AS kind, o_custkey AS id, count(DISTINCT o_orderkey) AS n_paths FROM orders GROUP BY ALL HAVING count(DISTINCT o_orderkey) > 1")
def agg10_idx001_uniqueness(spark, sf_dir):
    return lookups.index_uniqueness(read(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("kind"), F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("path")))


@query("SELECT o_custkey AS project_id, arg_min(o_orderpriority, o_orderkey) AS directory FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_custkey")
def agg11_primary_home(spark, sf_dir):
    return lookups.primary_home(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("project_id"), F.col("o_orderkey").alias("report_id"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("directory")))


@query("WITH t AS (SELECT o_custkey, o_orderpriority, max(o_orderkey % 50) AS top FROM orders WHERE o_orderkey % 2 = 0 GROUP BY ALL) SELECT o_orderkey, coalesce(top + 1, 0) + row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) - 1 AS position FROM orders LEFT JOIN t USING (o_custkey, o_orderpriority) WHERE o_orderkey % 2 = 1")
def agg12_end_of_band(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("report"), F.col("o_orderpriority").alias("severity"), (F.col("o_orderkey") % 50).alias("position"))
    return lookups.end_of_band_position(rows.where("o_orderkey % 2 = 1").drop("position"), rows.where("o_orderkey % 2 = 0"), "o_orderkey").select("o_orderkey", "position")


@query("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_nationkey) AS members FROM nation GROUP BY n_regionkey")
def agg13_agg15_ordered_members(spark, sf_dir):
    return lookups.ordered_members(read(spark, sf_dir, "nation"), "n_regionkey", ["n_nationkey"], "n_name", "members")


@query("WITH d AS (SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id % 2, text ORDER BY doc_id) AS k FROM documents) SELECT a.doc_id AS old_path, b.doc_id AS new_path FROM d a JOIN d b ON a.text = b.text AND a.k = b.k AND a.doc_id % 2 = 0 AND b.doc_id % 2 = 1")
def mat2_mat4_identical_pairs(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("hash"))
    return lookups.identical_pairs(d.where("path % 2 = 0"), d.where("path % 2 = 1"))


# Frontmatter, index rules, file sets, references and project texts.

@query("""WITH d AS (SELECT p_partkey AS doc_id, p_partkey % 12 AS k FROM part)
SELECT 'FND-001' AS rule_id, doc_id, CAST(NULL AS INTEGER) AS line, 'owner' AS message FROM d WHERE k = 0 UNION ALL SELECT 'FND-002', doc_id, NULL, 'severity' FROM d WHERE k = 1 UNION ALL SELECT 'FND-003', doc_id, NULL, 'urgent' FROM d WHERE k = 2
UNION ALL SELECT 'FND-004', doc_id, NULL, 'other' FROM d WHERE k = 3 UNION ALL SELECT 'FND-005', doc_id, NULL, 'no prefix' FROM d WHERE k = 4 UNION ALL SELECT 'FND-006', doc_id, NULL, 'CWE-' || p_size FROM d JOIN part ON p_partkey = doc_id WHERE p_size > 40
UNION ALL SELECT 'FND-007', doc_id, NULL, 'repeated tag' FROM d WHERE k = 5 UNION ALL SELECT 'FND-008', doc_id, NULL, 'affected entities on a library finding' FROM d WHERE k % 3 = 0""")
def fnd001_008_frontmatter(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    k = F.col("p_partkey") % 12
    pair = lambda name, value: F.struct(F.lit(name).alias("k"), value.alias("v"))
    pairs = F.array_compact(F.array(
        F.when(k == 0, pair("owner", F.lit("x"))), F.when(k != 1, pair("severity", F.when(k == 2, "urgent").otherwise("high"))), pair("finding_type", F.when(k == 3, "other").otherwise("web")),
        F.when(k == 4, pair("cvss", F.lit("AV:N"))), pair("affected_entities", F.lit("host")),
    ))
    docs = part.select(F.col("p_partkey").alias("doc_id"), F.when(k % 3 == 0, "library").otherwise("instance").alias("tier"), F.map_from_entries(pairs).alias("fields"), F.array("p_size").alias("cwe"), F.when(k == 5, F.array(F.lit("a"), F.lit("A"))).otherwise(F.array(F.lit("a"))).alias("tags"))
    return documents.frontmatter_rules(docs, part.where("p_size <= 40").select(F.col("p_size").alias("cwe_id")))


INDEX = """WITH i AS (SELECT o_orderkey AS k, CASE o_orderkey % 6 WHEN 0 THEN 'findings/library/' || o_orderkey || '.md' WHEN 1 THEN 'findings/reports/r' || o_custkey || '/evidence/' || o_orderkey || '.png' WHEN 2 THEN 'findings/inbox/' || o_orderkey || '.md'
 WHEN 3 THEN 'findings/reports/r' || o_custkey || '/' || o_orderkey || '.md' WHEN 4 THEN 'methodology/library/b' || o_orderkey ELSE 'findings/reports/r' || o_custkey END AS path, CASE WHEN o_orderkey % 7 = 0 THEN 'page' ELSE CASE o_orderkey % 6 WHEN 0 THEN 'library_finding' WHEN 1 THEN 'evidence'
 WHEN 2 THEN 'reported_finding' WHEN 3 THEN 'reported_finding' WHEN 4 THEN 'book' ELSE 'report' END END AS kind, ['library_finding','evidence','reported_finding','reported_finding','book','report'][o_orderkey % 6 + 1] AS wanted FROM orders)"""


def index_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, key, report = F.col("o_orderkey") % 6, F.col("o_orderkey").cast("string"), F.concat(F.lit("findings/reports/r"), F.col("o_custkey").cast("string"))
    path = (
        F.when(k == 0, F.concat(F.lit("findings/library/"), key, F.lit(".md"))).when(k == 1, F.concat(report, F.lit("/evidence/"), key, F.lit(".png"))).when(k == 2, F.concat(F.lit("findings/inbox/"), key, F.lit(".md")))
        .when(k == 3, F.concat(report, F.lit("/"), key, F.lit(".md"))).when(k == 4, F.concat(F.lit("methodology/library/b"), key)).otherwise(report)
    )
    fit = F.when(k == 0, "library_finding").when(k == 1, "evidence").when(k.isin(2, 3), "reported_finding").when(k == 4, "book").otherwise("report")
    return read(spark, sf_dir, "orders").select(path.alias("path"), F.when(F.col("o_orderkey") % 7 == 0, "page").otherwise(fit).alias("kind"))


@query(INDEX + " SELECT 'IDX-003' AS rule_id, path, regexp_extract(path, '^(findings/reports/[^/]+)/', 1) AS message FROM i WHERE k % 6 IN (1, 3) AND regexp_extract(path, '^(findings/reports/[^/]+)/', 1) NOT IN (SELECT path FROM i WHERE kind = 'report')")
def idx003_unindexed_reports(spark, sf_dir):
    rows = index_rows(spark, sf_dir)
    return documents.unindexed_reports(rows.select("path"), rows)


# Documents that embed one file and link to another; each fifth file has been uploaded again.

EMBEDS = """WITH f AS (SELECT 'f' || n_nationkey || '.png' AS filename, n_nationkey + 1000 AS old_id, n_nationkey + CASE WHEN n_nationkey % 5 = 0 THEN 2000 ELSE 1000 END AS id, n_name AS caption, CASE WHEN n_nationkey % 2 = 1 THEN 'seen' END AS description FROM nation),
d AS (SELECT doc_id, source, 'f' || doc_id % 50 || '.png' AS a, 'f' || doc_id % 7 || '.png' AS b FROM documents)"""


def embedding_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    file = lambda n: F.concat(F.lit("evidence/f"), (F.col("doc_id") % n).cast("string"), F.lit(".png"))
    body = F.concat(F.lit("![old]("), file(50), F.lit(")\n"), F.coalesce("source", F.lit("")), F.lit(" see [x]("), file(7), F.lit(") end\n"))
    return read(spark, sf_dir, "documents").select("doc_id", F.lit("r").alias("folder"), body.alias("text"))


def file_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    return read(spark, sf_dir, "nation").select(
        F.lit("r").alias("folder"), F.concat(F.lit("f"), n.cast("string"), F.lit(".png")).alias("filename"), (n + 1000).alias("old_id"), (n + F.when(n % 5 == 0, 2000).otherwise(1000)).alias("id"), F.col("n_name").alias("caption"), F.when(n % 2 == 1, "seen").alias("description"),
    )


@query(EMBEDS + """ SELECT doc_id, '![](' || coalesce(CAST(x.id AS VARCHAR), 'unresolved') || ')' || chr(10) || coalesce(source, '') || ' see [' || y.id || '](' || y.id || ') end' AS prose, CASE WHEN x.id <> x.old_id OR y.id <> y.old_id THEN 'PUSH' ELSE 'CLEAN' END AS outcome
FROM d LEFT JOIN f x ON x.filename = d.a LEFT JOIN f y ON y.filename = d.b""")
def rec14_ripple_push(spark, sf_dir):
    docs, files = embedding_docs(spark, sf_dir), file_rows(spark, sf_dir)
    state = reconcile.prose_with_ids(docs, files.select("folder", "filename", F.col("old_id").alias("id"))).select("doc_id", F.sha2("prose", 256).alias("base_hash"))
    return reconcile.ripple_push(docs, files, state)


@query(EMBEDS + """ SELECT doc_id, '![' || coalesce(caption, 'old') || '](evidence/' || a || coalesce(' "' || description || '"', '') || ')' || chr(10) || coalesce(source, '') || ' see [x](evidence/' || b || ') end' || chr(10) AS text FROM d LEFT JOIN f ON filename = a""")
def rec15_rewrite_captions(spark, sf_dir):
    return reconcile.rewrite_captions(embedding_docs(spark, sf_dir), file_rows(spark, sf_dir))


FILES = SLOTS.replace(
    "\nk AS", """
u AS (SELECT id, mode, l AS lb, r AS rb, b AS bb, CASE WHEN id % 9 = 0 THEN 'x' END AS lc, CASE WHEN id % 4 = 0 THEN 'y' END AS rc FROM s),
t AS (SELECT *, lb || chr(10) || coalesce(lc, rc, '') AS l, rb || chr(10) || coalesce(rc, '') AS r, bb || chr(10) || coalesce(rc, '') AS b FROM u),
k AS""", 1).replace("FROM s),\nc AS", "FROM t),\nc AS")


@query(FILES + " SELECT id, CASE WHEN lb IS NOT NULL AND id % 37 = 0 THEN 'FAILED' WHEN o1 = 'PUSH' AND lb <> rb THEN 'MOVE_EDIT' ELSE o1 END AS outcome FROM c")
def rec13_file_sets(spark, sf_dir):
    k = F.col("id")
    rows = slots(spark, sf_dir).withColumnsRenamed({"local_hash": "local_body", "remote_hash": "remote_body"}).withColumns({"local_caption": F.when(k % 9 == 0, "x"), "remote_caption": F.when(k % 4 == 0, "y"), "conflict": k % 37 == 0})
    base = F.when(F.col("base_hash").isNotNull(), F.sha2(F.concat_ws("\n", "base_hash", F.coalesce("remote_caption", F.lit(""))), 256))
    return reconcile.file_set_plan(rows.withColumn("base_hash", base)).select("id", "outcome")


@query(SLOTS + " SELECT id, CASE WHEN o1 IN ('PUSH','DELETE_REMOTE') AND id % 3 = 0 THEN 'COLLISION' ELSE o1 END AS outcome FROM c")
def rec11_drift_check(spark, sf_dir):
    plan = reconcile.classify(slots(spark, sf_dir)).withColumn("forced", F.lit(False))
    now = plan.select("kind", "id", F.when(F.col("id") % 3 == 0, "later").otherwise(F.col("remote_hash")).alias("now_hash"))
    return reconcile.drift_check(plan, now).select("id", "outcome")


@query("SELECT o_orderkey AS id, 'q/' || o_orderkey AS new_path, CASE WHEN o_orderkey % 15 = 0 THEN 'FAILED' ELSE 'MOVE' END AS outcome FROM orders WHERE o_orderkey % 3 = 0")
def rec12_relocate(spark, sf_dir):
    rows = slots(spark, sf_dir).select("id", "path", F.when(F.col("id") % 3 == 0, "q").otherwise("p").alias("remote_parent"))
    taken = rows.where("id % 5 = 0").select(F.concat(F.lit("q/"), F.col("id").cast("string")).alias("path"))
    return reconcile.relocate(rows, taken).select("id", "new_path", "outcome")


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'written' WHEN 1 THEN 'hand-edited' WHEN 2 THEN 'unchanged' ELSE 'written' END AS state FROM documents")
def rec17_mirror_state(spark, sf_dir):
    k, body = F.col("doc_id") % 4, F.coalesce("text", F.lit(""))
    current = F.when(k == 1, F.concat(body, F.lit("!"))).when(k != 0, body)
    new = F.when(k == 3, F.concat(body, F.lit("?"))).otherwise(body)
    return read(spark, sf_dir, "documents").select("doc_id", reconcile.mirror_state(F.sha2(body, 256), current, new).alias("state"))


CONTEXT = """WITH o AS (SELECT o_custkey AS c, o_orderkey AS k, o_orderpriority AS p, o_orderstatus AS s FROM orders),
a AS (SELECT c, string_agg(chr(10) || '### ' || p || CASE s WHEN 'F' THEN ' (EXCLUDED)' WHEN 'P' THEN ' (EXCLUDED, CAUTION)' ELSE '' END || CASE WHEN k % 8 = 0 THEN chr(10) || chr(10) || 'about ' || k ELSE '' END || chr(10) || chr(10) || '- ' || k || chr(10) || '- b', chr(10) ORDER BY k) AS t FROM o WHERE k % 4 = 0 GROUP BY c),
b AS (SELECT c, string_agg('- **' || k || '** \u2014 ' || s || ' / ' || p || CASE WHEN s = 'F' THEN ' [COMPLETE]' ELSE ' (deadline: soon)' END || chr(10) || '  why' || CASE WHEN k % 8 = 1 THEN chr(10) || '  Result: done' ELSE '' END, chr(10) ORDER BY k) AS t FROM o WHERE k % 4 = 1 GROUP BY c),
e AS (SELECT c, string_agg('- ' || CASE WHEN s = 'O' THEN 'unknown target' ELSE 'h' || k || ' / ' || s END || CASE WHEN s = 'F' THEN ' (COMPROMISED)' ELSE '' END || chr(10) || '  T' || k, chr(10) ORDER BY k) AS t FROM o WHERE k % 4 = 2 GROUP BY c),
w AS (SELECT c, string_agg(chr(10) || '### ' || k || ' \u2014 ' || p || chr(10) || chr(10) || 'a & b' || chr(10) || 'c', chr(10) ORDER BY k) AS t FROM o WHERE k % 4 = 3 GROUP BY c)
SELECT c_custkey AS project_id, '# ' || c_name || chr(10) || chr(10) || '**Client:** ' || c_name || chr(10) || '**Dates:** 2024-01-01 \u2013 ' || CASE WHEN c_custkey % 2 = 0 THEN '2024-02-01' ELSE '' END || coalesce(chr(10) || chr(10) || '## Scope' || chr(10) || a.t, '') || coalesce(chr(10) || chr(10) || '## Objectives' || chr(10) || chr(10) || b.t, '')
 || coalesce(chr(10) || chr(10) || '## Targets' || chr(10) || chr(10) || e.t, '') || coalesce(chr(10) || chr(10) || '## White cards' || chr(10) || w.t, '') || chr(10) || chr(10) || '## Collab note' || chr(10) || chr(10) || c_mktsegment || ' \u00e9' || chr(10) AS context
FROM customer LEFT JOIN a ON a.c = c_custkey LEFT JOIN b ON b.c = c_custkey LEFT JOIN e ON e.c = c_custkey LEFT JOIN w ON w.c = c_custkey"""


@query(CONTEXT)
def agg14_project_context(spark, sf_dir):
    key, s, p = F.col("o_orderkey").cast("string"), F.col("o_orderstatus"), F.col("o_orderpriority")
    orders = read(spark, sf_dir, "orders").withColumns({"project_id": F.col("o_custkey"), "pos": F.col("o_orderkey")})
    quarter = lambda k: orders.where(F.col("o_orderkey") % 4 == k)
    return lookups.project_context(
        read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("project_id"), F.lit("").alias("codename"), F.col("c_name").alias("client"), F.lit("2024-01-01").alias("start"), F.when(F.col("c_custkey") % 2 == 0, "2024-02-01").alias("end"), F.concat(F.lit("<p>"), "c_mktsegment", F.lit(" &eacute;</p>")).alias("collab")),
        quarter(0).select("project_id", "pos", p.alias("name"), F.concat(key, F.lit("\r\n\n b ")).alias("entries"), s.isin("F", "P").alias("disallowed"), (s == "P").alias("caution"), F.when(F.col("o_orderkey") % 8 == 0, F.concat(F.lit(" about "), key)).alias("description")),
        quarter(1).select("project_id", "pos", key.alias("objective"), s.alias("status"), p.alias("priority"), F.when(s != "F", "soon").alias("deadline"), (s == "F").alias("complete"), F.lit("why").alias("description"), F.when(F.col("o_orderkey") % 8 == 1, "done").alias("result")),
        quarter(2).select("project_id", "pos", F.when(s != "O", F.concat(F.lit("h"), key)).alias("hostname"), F.when(s != "O", s).alias("ip"), (s == "F").alias("compromised"), F.concat(F.lit("T"), key).alias("description")),
        quarter(3).select("project_id", "pos", key.alias("title"), p.alias("issued"), F.lit("<p>a &amp; b</p><ul><li>c</li></ul>").alias("description")),
    )


@query(SLOTS + """, g AS (SELECT kind, count(*) FILTER (l IS NOT NULL AND id % 19 = 0) AS invalid, count(*) FILTER (l IS NULL AND id % 19 >= 0 AND b IS NOT NULL) AS deleted, count(*) FILTER (b IS NULL AND l IS NULL) AS deleted2,
 count(*) FILTER (l IS NOT NULL AND id % 19 <> 0 AND b IS NULL) AS unknown, count(*) FILTER (l = b AND id % 19 <> 0) AS clean, count(*) FILTER (l <> b AND id % 19 <> 0) AS edited FROM s GROUP BY kind),
m AS (SELECT kind, count(*) FILTER (l IS NULL AND b IS NOT NULL AND id % 22 = 0) AS moved, count(*) FILTER (id % 50 = 1) AS fresh FROM s GROUP BY kind)
SELECT kind, unnest(['clean','edited','deleted','unknown','invalid','new','moved']) AS status, unnest([clean, edited, deleted + deleted2 - moved, unknown, invalid, fresh, moved]) AS n FROM g JOIN m USING (kind)""")
def rec16_agg7_offline_status(spark, sf_dir):
    rows = slots(spark, sf_dir)
    failures = rows.where("id % 19 = 0").select("path", F.lit("WS-001").alias("rule_id"))
    own = F.concat(F.lit("h"), F.col("id").cast("string"))
    indexed = rows.select("path", "kind", F.when(F.col("local_hash").isNull() & F.col("base_hash").isNotNull(), own).otherwise(F.col("base_hash")).alias("base_hash"))
    elsewhere = lambda folder, some, content: rows.where(some).select(F.concat(F.lit(folder), F.col("id").cast("string")).alias("path"), "kind", content.alias("local_hash"))
    local = rows.where("local_hash is not null").select("path", "kind", "local_hash").unionByName(elsewhere("moved/", "local_hash is null and base_hash is not null and id % 22 = 0", own)).unionByName(elsewhere("new/", "id % 50 = 1", F.concat(F.lit("n"), own)))
    return lookups.status_counts(reconcile.offline_status(local, indexed, failures), rows, ["clean", "edited", "deleted", "unknown", "invalid", "new", "moved"])


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'a/' || p_partkey || '.remote.md' WHEN 1 THEN 'a/' || p_partkey || '.remote' ELSE 'a/' || p_partkey || '.remote.remote.md' END AS sidecar, p_partkey % 3 = 2 AS is_sidecar FROM part")
def rec18_sidecars(spark, sf_dir):
    k = F.col("p_partkey") % 3
    path = F.concat(F.lit("a/"), F.col("p_partkey").cast("string"), F.when(k == 0, ".md").when(k == 1, "").otherwise(".remote.md"))
    return read(spark, sf_dir, "part").select("p_partkey", text.sidecar_name(path).alias("sidecar"), text.is_sidecar(path).alias("is_sidecar"))
