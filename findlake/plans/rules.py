"""Registered queries of rules, canonical forms and runs, each beside its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from findlake.functions import text
from findlake.operators import documents, lookups, reconcile, records, rules
from findlake.plans.queries import LINES, SLOTS, query, read, slots


def key():
    return F.col("doc_id").cast("string")


@query("""SELECT 'WIKI-001' AS rule_id, c_custkey AS doc_id, CAST(NULL AS INTEGER) AS line, 'owner' AS message FROM customer WHERE c_custkey % 5 = 0
UNION ALL SELECT 'WIKI-002', c_custkey, NULL, 'no title' FROM customer WHERE c_custkey % 5 IN (1, 2) UNION ALL SELECT 'WIKI-003', c_custkey, NULL, c_mktsegment FROM customer WHERE c_custkey % 5 = 3""")
def wiki001_003_pages(spark, sf_dir):
    k = F.col("c_custkey") % 5
    pair = lambda name, value: F.struct(F.lit(name).alias("k"), value.alias("v"))
    pairs = F.array_compact(F.array(F.when(k == 0, pair("owner", F.lit("x"))), F.when(k != 1, pair("title", F.when(k == 2, " ").otherwise(F.col("c_name")))), F.when(k >= 3, pair("priority", F.when(k == 3, F.col("c_mktsegment")).otherwise("-12")))))
    return rules.page_frontmatter_rules(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.map_from_entries(pairs).alias("fields")))


@query(r"""WITH u AS (SELECT page_id AS doc_id, unnest(string_split(html, chr(10))) AS content, generate_subscripts(string_split(html, chr(10)), 1) AS line FROM pages),
m AS (SELECT doc_id, line, unnest(regexp_extract_all(regexp_replace(content, '`[^`]*`', '', 'g'), '<(?:!|\?|/?\s*([A-Za-z][A-Za-z0-9-]*))[^>]*>')) AS m FROM u)
SELECT 'WIKI-005' AS rule_id, doc_id, CAST(line AS INTEGER) AS line, substr(m, 1, 60) AS message FROM m WHERE lower(regexp_extract(m, '<(?:!|\?|/?\s*([A-Za-z][A-Za-z0-9-]*))[^>]*>', 1)) IN ('', """ + ", ".join(f"'{t}'" for t in rules.HTML_TAGS) + ")")
def wiki005_raw_html(spark, sf_dir):
    return rules.raw_html_rule(documents.explode_lines(read(spark, sf_dir, "pages"), "page_id", "html", fences=True))


SCHEMES = ["[x](JavaScript:x)", "![x](ftp://host/x)", "[x](mailto:a@b)", "![x](images/a.png)", "<tel:1>", "[x][L]", "`[x](ftp://no)`"]


@query("""SELECT 'WIKI-006' AS rule_id, doc_id, CAST(1 AS INTEGER) AS line, CASE doc_id % 7 WHEN 0 THEN 'javascript: JavaScript:x' WHEN 1 THEN 'ftp: ftp://host/x' WHEN 4 THEN 'tel: tel:1' ELSE 'data: data:x' END AS message
FROM documents WHERE doc_id % 7 IN (0, 1, 4, 5)""")
def wiki006_link_schemes(spark, sf_dir):
    """Links and images of every form in front of whole texts."""
    form = F.element_at(F.array(*map(F.lit, SCHEMES)), (F.col("doc_id") % len(SCHEMES) + 1).cast("int"))
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\[\]<>`~]", "")
    whole = F.concat(form, F.lit("\n\n"), plain, F.lit("\n\n[l]: data:x\n"))
    return documents.link_scheme_rule(documents.references(documents.explode_lines(read(spark, sf_dir, "documents").select("doc_id", whole.alias("text")), fences=True)))


@query("""SELECT 'WIKI-008' AS rule_id, doc_id, CAST(2 AS INTEGER) AS line, m AS message FROM documents, (SELECT unnest(['U+200B', 'U+202E']) AS m) WHERE doc_id % 3 = 0 AND text IS NOT NULL
UNION ALL SELECT 'WIKI-008', doc_id, 2, 'U+FEFF' FROM documents WHERE doc_id % 3 = 1 AND text IS NOT NULL""")
def wiki008_invisible(spark, sf_dir):
    k = F.col("doc_id") % 3
    marked = F.concat(F.lit("x\n"), F.when(k == 0, "a​b‮").when(k == 1, "﻿").otherwise("⁡"), F.lit("\n"), F.col("text"))
    return documents.control_characters(documents.explode_lines(read(spark, sf_dir, "documents").select("doc_id", marked.alias("text"))))


BODY = "WITH d AS (SELECT doc_id FROM documents WHERE text IS NOT NULL) "


@query(BODY + """SELECT 'FND-013' AS rule_id, doc_id, CAST(2 AS INTEGER) AS line, 'missing title' AS message FROM d WHERE doc_id % 4 = 1 UNION ALL SELECT 'FND-013', doc_id, 2, 'blank title' FROM d WHERE doc_id % 4 = 2
UNION ALL SELECT 'FND-016', doc_id, 3, 'text outside sections' FROM d WHERE doc_id % 4 = 3""")
def fnd013_fnd016_titles(spark, sf_dir):
    k = F.col("doc_id") % 4
    front = F.when(k == 0, "\n# T\n").when(k == 1, "\nstray\n").when(k == 2, "\n#  \n").otherwise("\n# T\nstray\n")
    body = F.concat(front, F.lit("## Description\n"), F.col("text"))
    return rules.title_rules(read(spark, sf_dir, "documents").where("text is not null").select("doc_id", body.alias("text")))


@query("""WITH p AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H' WHEN 1 THEN 'AV:N/AC:L/PR:N/UI:N/S:U/C:N/I:N/A:N' ELSE 'AV:L' END AS v, CASE WHEN p_partkey % 2 = 0 THEN 'critical' ELSE 'low' END AS severity, p_partkey % 5 = 0 AS inbox FROM part)
SELECT 'FND-015' AS rule_id, p_partkey AS doc_id, CAST(NULL AS INTEGER) AS line, severity || ' for ' || CASE p_partkey % 3 WHEN 0 THEN '9.8' ELSE '0.0' END AS message FROM p WHERE NOT inbox AND (p_partkey % 3 = 0 AND severity = 'low' OR p_partkey % 3 = 1 AND severity = 'critical')""")
def fnd015_severity_band(spark, sf_dir):
    k = F.col("p_partkey")
    vector = F.concat(F.lit("CVSS:3.1/"), F.when(k % 3 == 0, "AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H").when(k % 3 == 1, "AV:N/AC:L/PR:N/UI:N/S:U/C:N/I:N/A:N").otherwise("AV:L"))
    return rules.severity_rule(read(spark, sf_dir, "part").select(k.alias("doc_id"), F.when(k % 5 == 0, "inbox").otherwise("library").alias("tier"), F.when(k % 2 == 0, "critical").otherwise("low").alias("severity"), vector.alias("cvss")))


@query("""SELECT 'FND-017' AS rule_id, doc_id, CAST(NULL AS INTEGER) AS line, CASE WHEN doc_id % 3 = 0 THEN 'missing' ELSE 'not valid' END AS message FROM documents WHERE text IS NOT NULL AND doc_id % 3 < 2""")
def fnd017_wiki014_frontmatter(spark, sf_dir):
    k = F.col("doc_id") % 3
    front = F.when(k == 0, "no fence\n").when(k == 1, "---\nseverity: high\nthis is no field\n---\n").otherwise("---\nseverity: high\ntags:\n  - a\n# note\n---\n")
    return rules.frontmatter_rule(read(spark, sf_dir, "documents").select("doc_id", F.concat(front, "text").alias("text")), "FND-017")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'a: ' || doc_id || chr(10) END AS header, md5(CASE WHEN doc_id % 2 = 0 THEN text ELSE 'x' || text END) AS digest FROM documents")
def doc2_frontmatter(spark, sf_dir):
    whole = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("---\na: "), key(), F.lit("\n---\n"), F.coalesce("text", F.lit("")))).otherwise(F.concat(F.lit("x"), "text"))
    return documents.frontmatter_split(read(spark, sf_dir, "documents").where("text is not null").select("doc_id", whole.alias("text"))).select("doc_id", "header", F.md5("body").alias("digest"))


@query("""WITH d AS (SELECT doc_id, doc_id % 4 AS k, regexp_replace(text, '[{}]', '', 'g') AS t FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, unnest(CASE k WHEN 0 THEN [struct_pack(literal := false, piece := 'a' || chr(10), closed := CAST(NULL AS BOOLEAN)), struct_pack(literal := true, piece := t, closed := false)]
 WHEN 1 THEN [struct_pack(literal := true, piece := 'x' || chr(10) || t, closed := true), struct_pack(literal := false, piece := t || 'end', closed := NULL)]
 WHEN 2 THEN [struct_pack(literal := false, piece := t, closed := NULL)] ELSE [struct_pack(literal := false, piece := 'a', closed := NULL), struct_pack(literal := true, piece := 'b ' || t || ' c', closed := true), struct_pack(literal := true, piece := 'd', closed := true)] END) AS x FROM d)
SELECT doc_id, x.literal AS literal, md5(x.piece) AS digest, x.closed AS closed FROM p WHERE x.piece <> ''""")
def doc10_raw_spans(spark, sf_dir):
    """Raw text of every form around whole texts: never closed, closed within a line, closed without an opening, opened twice."""
    k, plain = F.col("doc_id") % 4, F.regexp_replace("text", r"[{}]", "")
    marked = (
        F.when(k == 0, F.concat(F.lit("a\n{% raw %}"), plain)).when(k == 1, F.concat(F.lit("{%- raw -%}x\n"), plain, F.lit("{%-endraw%}"), plain, F.lit("end"))).when(k == 2, F.concat(F.lit("{% endraw %}"), plain))
        .otherwise(F.concat(F.lit("a{%raw%}b {% raw -%}"), plain, F.lit(" c{%  endraw  %}{% endraw %}{%raw%}d{%endraw%}")))
    )
    found = documents.raw_spans(read(spark, sf_dir, "documents").where("text is not null").select("doc_id", marked.alias("text")))
    return found.select("doc_id", "literal", F.md5("piece").alias("digest"), "closed")


FENCES = [("```", "", "```", True), ("~~~~", "~~~", "~~~~ ", True), ("````py", "```", "`````", True), ("  ~~~", "```", "~~~", True), ("``` a`b", "", "x", False), ("    ```", "", "x", False), ("```", "~~~", "", True)]


@query("WITH f AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {str(code).lower()}, {2 if not code else 3 if i < 6 else 1000000000})" for i, (*_, code) in enumerate(FENCES)) + """) v(i, code, width)),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS line, len(string_split(text, chr(10))) - CASE WHEN text LIKE '%' || chr(10) THEN 1 ELSE 0 END AS n FROM documents WHERE text <> '')
SELECT doc_id, count(*) + 4 AS n_lines, CASE WHEN any_value(code) THEN CASE WHEN any_value(width) > 3 THEN count(*) + 3 ELSE 3 END ELSE 0 END AS n_code FROM l JOIN f ON doc_id % 7 = i WHERE line <= n GROUP BY doc_id""")
def win8_fence_state(spark, sf_dir):
    """Lines in code of whole texts behind one plain line and a block of each kind of fence; the last kind is never closed."""
    k = F.col("doc_id") % len(FENCES)
    part = lambda i: F.element_at(F.array(*[F.lit(f[i]) for f in FENCES]), (k + 1).cast("int"))
    docs = read(spark, sf_dir, "documents").where("text <> ''")
    text = F.concat(F.lit("plain\n"), part(0), F.lit("\n"), part(1), F.lit("\n"), part(2), F.lit("\n"), "text")
    rows = documents.explode_lines(docs.select("doc_id", text.alias("text")), fences=True)
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.col("in_code").cast("long")).alias("n_code"))


REFS = [
    ("see ![a **b**](evidence/x%20y.png \"T\") here", "embed", "a b", "evidence/x y.png", "T", False, False), ("![c [d]](evidence/z.png)", "embed", "c [d]", "evidence/z.png", "", True, False), ("- item [x](a.md) and", "cross_reference", "x", "a.md", "", False, True),
    ("[Label]", "cross_reference", "Label", "b.md", "Two words", False, False), ("[text][label]", "cross_reference", "text", "b.md", "Two words", False, False), ("<https://h/p>", "cross_reference", "https://h/p", "https://h/p", "", False, False), ("1. one\n\n   ![in](e.png)", "embed", "in", "e.png", "", True, True),
    ("[![alt](i.png)](t.md)", "cross_reference", "alt", "t.md", "", False, False), ("`[no](no.md)` \\\\ [lost]", None, None, None, None, None, None),
]


@query("WITH r AS (SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else f"'{v}'" for v in (i, *row[1:], 5 if i == 6 else 3)) + ")" for i, row in enumerate(REFS)) + """, (7, 'embed', 'alt', 'i.png', '', false, false, 3)) v(i, kind, caption, ref_path, title, standalone, in_list_item, line))
SELECT doc_id, line::INT AS line, kind, caption, ref_path, title, standalone, in_list_item FROM documents JOIN r ON doc_id % 9 = i WHERE kind IS NOT NULL""")
def doc4_references(spark, sf_dir):
    """Every form of reference before whole texts, its definition at their end."""
    k = F.col("doc_id") % len(REFS)
    form = F.element_at(F.array(*[F.lit(r[0]) for r in REFS]), (k + 1).cast("int"))
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\[\]<>`~]", "")
    text = F.concat(F.lit("# T\n\n"), form, F.lit("\n\nEnd.\n\n"), plain, F.lit("\n\n[LABEL]: b.md 'Two words'\n[label]: other.md\n"))
    rows = documents.reference_lines(read(spark, sf_dir, "documents").select("doc_id", text.alias("text")))
    return documents.references(rows).select("doc_id", "line", "kind", "caption", "ref_path", "title", "standalone", "in_list_item")


@query("SELECT doc_id, CAST(1 AS INTEGER) AS line, phrase FROM (SELECT doc_id, unnest(CASE doc_id % 4 WHEN 0 THEN ['as an ai', 'as an ai language model'] WHEN 1 THEN ['i''ve updated'] WHEN 3 THEN ['as requested'] ELSE [] END) AS phrase FROM documents WHERE text IS NOT NULL)")
def txt001_doc8_banned_phrases(spark, sf_dir):
    k = F.col("doc_id") % 4
    planted = F.when(k == 0, "As an  AI language model").when(k == 1, "(I've updated)").when(k == 2, "has requested").otherwise("as requested.")
    return documents.scan_phrases(documents.explode_lines(read(spark, sf_dir, "documents").select("doc_id", F.concat(planted, F.lit("\n"), "text").alias("text"))))


@query("SELECT 'REF-005' AS rule_id, doc_id, CAST(1 AS INTEGER) AS line, 'evidence/' || doc_id || '.png' AS message FROM documents WHERE doc_id % 3 < 2 AND doc_id % 2 = 0 AND text IS NOT NULL")
def ref005_library_images(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    marked = docs.select("doc_id", F.concat(F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("![a](evidence/"), key(), F.lit(".png)\n"))).otherwise("![a](https://x/y.png)\n"), F.regexp_replace("text", r"[\[\]`~]", "")).alias("text"))
    k = F.col("doc_id") % 3
    return rules.image_in_library_rule(documents.explode_lines(marked, fences=True), docs.select("doc_id", F.when(k == 0, "library").when(k == 1, "inbox").otherwise("instance").alias("tier")))


@query("SELECT 'REF-007' AS rule_id, doc_id, CAST(1 AS INTEGER) AS line, CASE WHEN doc_id % 4 = 1 THEN 'images/a.png: expected ../images/' ELSE '../images/a.png: expected images/' END AS message FROM documents WHERE doc_id % 4 IN (1, 2) AND text IS NOT NULL")
def ref007_image_paths(spark, sf_dir):
    docs, k = read(spark, sf_dir, "documents"), F.col("doc_id") % 4
    marked = docs.select("doc_id", F.concat(F.when(k.isin(0, 1), "![a](images/a.png)\n").otherwise("![a](../images/a.png)\n"), F.regexp_replace("text", r"[\[\]`~]", "")).alias("text"))
    pages = docs.select("doc_id", F.concat(F.lit("methodology/library/b/"), F.when(k % 2 == 1, "c/").otherwise(""), key(), F.lit(".md")).alias("path"))
    return rules.image_path_rule(documents.explode_lines(marked, fences=True), pages)


#: Shapes of paths with a number in them: what stands before and after it, whether the place is known, the badly named segments.
PLACES = [
    ("findings/library/", ".md", True, []), ("findings/library/x/", ".md", False, []), ("methodology/drafts/", ".md", False, []), ("findings/inbox/", ".md", True, []), ("notes/Odd ", "", None, []), ("findings/reports/R %d/", ".md", True, ["R %d"]), ("methodology/library/b/c/", ".md", True, []),
    ("findings/reports/r/.hidden", "/x/y.md", False, []), ("findings/reports/r%d/.report.yml", None, True, []), ("methodology/library/b%d/c/.chapter.yml", None, True, []), ("findings/reports/r/evidence/Odd ", ".PNG", True, []), ("findings/reports/r/evidence/deep/Odd ", ".png", True, ["Odd %d.png"]),
    ("methodology/library/b/images/A ", ".png", True, []), ("methodology/checklists/e%d/c/x.md", None, True, []), ("methodology/library/.shelves/s%d.yml", None, True, []), ("methodology/shelves/s%d.yml", None, False, []), ("findings/reports/R x/N y/", ".txt", False, ["R x", "N y"]), ("findings/reports/r/notes/", ".txt", False, []),
    ("methodology/library/b%d/.book.yml", None, True, []),
]


def _shape(before, after):
    return before if after is None else before + "%d" + after


def placed(spark, sf_dir):
    n = F.col("o_orderkey").cast("string")
    shapes = F.array(*[F.lit(_shape(*p[:2])) for p in PLACES])
    return read(spark, sf_dir, "orders").select(F.replace(F.element_at(shapes, (F.col("o_orderkey") % len(PLACES) + 1).cast("int")), F.lit("%d"), n).alias("path"))


def _places(rows):
    values = ", ".join("(" + ", ".join("NULL" if v is None else str(v) if isinstance(v, int) else f"'{v}'" for v in row) + ")" for row in rows)
    return f"WITH r AS (SELECT * FROM (VALUES {values}) v(i, rule_id, shape, message)), p AS (SELECT rule_id, replace(shape, '%d', o_orderkey::VARCHAR) AS path, replace(message, '%d', o_orderkey::VARCHAR) AS message FROM orders JOIN r ON o_orderkey % {len(PLACES)} = i) "


@query(_places([(i, "WS-002" if p[0].startswith("findings") else "WS-003", _shape(*p[:2]), "") for i, p in enumerate(PLACES) if p[2] is False]) + "SELECT rule_id, path FROM p")
def ws002_ws003_places(spark, sf_dir):
    return rules.place_rules(placed(spark, sf_dir))


@query(_places([(i, "WS-001", _shape(*p[:2]), bad) for i, p in enumerate(PLACES) for bad in p[3]]) + "SELECT rule_id, path, message FROM p")
def ws001_segments(spark, sf_dir):
    return rules.segment_rule(placed(spark, sf_dir))


#: Shapes of paths and the kinds that they imply.
KINDS = [
    ("findings/library/%d.md", "library_finding"), ("findings/library/x/%d.md", None), ("findings/reports/r%d", "report"), ("findings/reports/r/%d.md", "reported_finding"), ("findings/reports/r/%d.txt", None), ("findings/reports/%d.md", "report"), ("findings/reports/r/evidence/%d.png", "evidence"),
    ("findings/reports/r/evidence/x/%d.png", None), ("findings/reports/r/notes/%d.md", "note"), ("findings/reports/r/narrative/%d.md", "narrative"), ("findings/inbox/%d.md", None), ("methodology/library/.shelves/%d.yml", "shelf"), ("methodology/shelves/%d.yml", None), ("methodology/library/b%d", "book"),
    ("methodology/library/b/%d.md", "page"), ("methodology/library/b/c%d", "chapter"), ("methodology/library/b/images/%d.png", "image"), ("methodology/library/b/images/%d.md", "image"), ("methodology/library/b/c/%d.md", "page"), ("methodology/checklists/e%d/c/x.md", None), ("methodology/checklists/e%d", None),
]


def kind_rows(spark, sf_dir):
    n, i = F.col("o_orderkey").cast("string"), (F.col("o_orderkey") % len(KINDS) + 1).cast("int")
    path = F.replace(F.element_at(F.array(*[F.lit(k[0]) for k in KINDS]), i), F.lit("%d"), n)
    own = F.element_at(F.array(*[F.lit(k[1]) for k in KINDS]), i)
    return read(spark, sf_dir, "orders").select(path.alias("path"), F.when(F.floor(F.col("o_orderkey") / 30) % 2 == 0, "user").otherwise(F.coalesce(own, F.lit("page"))).alias("kind"))


KIND_ROWS = "WITH r AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{shape}', {'NULL' if kind is None else repr(kind)})" for i, (shape, kind) in enumerate(KINDS)) + f""") v(i, shape, wanted)),
p AS (SELECT replace(shape, '%d', o_orderkey::VARCHAR) AS path, wanted, (o_orderkey // 30) % 2 = 0 AS odd FROM orders JOIN r ON o_orderkey % {len(KINDS)} = i) """


@query(KIND_ROWS + "SELECT path, wanted AS expected FROM p")
def fil9_expected_kind(spark, sf_dir):
    return kind_rows(spark, sf_dir).select("path", text.expected_kind(F.col("path")).alias("expected"))


@query(KIND_ROWS + """SELECT CASE WHEN path LIKE '%/evidence/%' OR path LIKE '%/images/%' THEN 'IDX-004' ELSE 'IDX-002' END AS rule_id, path, wanted AS message FROM p WHERE odd AND wanted IS NOT NULL
UNION ALL SELECT 'IDX-002', path, 'local-only tree' FROM p WHERE path LIKE 'findings/inbox/%' OR path LIKE 'methodology/checklists/%'""")
def idx002_idx004_kinds(spark, sf_dir):
    return documents.index_rules(kind_rows(spark, sf_dir))


@query("SELECT 'WS-010' AS rule_id, 'r/' || event_id AS path, CASE event_id % 4 WHEN 0 THEN 'not an object' WHEN 1 THEN 'missing at' ELSE 'unknown more' END AS message FROM events WHERE event_id % 4 < 3")
def ws010_generated(spark, sf_dir):
    k = F.col("event_id") % 4
    value = F.get_json_object("props", "$.k")
    body = F.when(k == 0, F.concat(F.lit("{k: "), value)).when(k == 1, F.col("props")).when(k == 2, F.concat(F.lit('{"k": '), value, F.lit(', "at": 1, "more": 2}'))).otherwise(F.concat(F.lit('{"at": 1, "k": '), value, F.lit("}")))
    return rules.generated_rule(read(spark, sf_dir, "events").select(F.concat(F.lit("r/"), F.col("event_id").cast("string")).alias("path"), body.alias("text")), ["k", "at"])


@query("SELECT 'REP-002' AS rule_id, 'n/' || doc_id AS path, CASE WHEN doc_id % 2 = 0 THEN 'indexed note without frontmatter' ELSE 'new note with frontmatter' END AS message FROM documents WHERE text IS NOT NULL AND (doc_id % 2 = 0 AND doc_id % 3 <> 0 OR doc_id % 2 = 1 AND doc_id % 3 = 0)")
def rep002_notes(spark, sf_dir):
    path = F.concat(F.lit("n/"), key())
    docs = read(spark, sf_dir, "documents").where("text is not null")
    notes = docs.select(path.alias("path"), F.concat(F.when(F.col("doc_id") % 3 == 0, "---\nauthor: a\n---\n").otherwise("x"), "text").alias("text"))
    return rules.note_rule(notes, docs.where("doc_id % 2 = 0").select(path.alias("path"), F.lit("note").alias("kind")))


@query("SELECT 'REP-003' AS rule_id, 'r' || o_custkey || '/' || o_orderkey AS path, o_orderpriority AS message FROM orders WHERE o_custkey % 3 <> 0 AND o_orderpriority NOT IN ('1-URGENT', '2-HIGH')")
def rep003_narrative(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("report"), F.col("o_orderpriority").alias("field"), F.concat(F.lit("r"), F.col("o_custkey").cast("string"), F.lit("/"), F.col("o_orderkey").cast("string")).alias("path"))
    order = read(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("report"), F.explode(F.array(F.lit("1-URGENT"), F.lit("2-HIGH"))).alias("field"))
    return rules.narrative_rule(o, order)


#: What ``documents.TRAILING`` takes as white space at the end of a line.
BLANKS = "".join(map(chr, [*range(0x9, 0xE), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


@query("""SELECT rule_id, count(*) AS n FROM (SELECT 'WIKI-009' AS rule_id FROM documents WHERE doc_id % 3 = 0 AND text IS NOT NULL UNION ALL SELECT 'WIKI-010' FROM documents WHERE doc_id % 3 = 1 AND text IS NOT NULL
UNION ALL SELECT 'WIKI-008' FROM documents WHERE doc_id % 5 = 0 AND text IS NOT NULL) GROUP BY rule_id""")
def set1_wiki009_010_failures(spark, sf_dir):
    k = F.col("doc_id")
    first = F.concat(F.when(k % 3 == 0, "a\r\nb\r\n").when(k % 3 == 1, "a \n").otherwise("a\n"), F.when(k % 5 == 0, "⁠\n").otherwise("x\n"))
    # whole texts, but for marks and for white space at the ends of their lines, which the rules would tell as well
    unmarked = F.when(F.octet_length("text") > F.length("text"), F.regexp_replace("text", documents.INVISIBLE, "")).otherwise(F.col("text"))
    bare = F.array_join(F.transform(F.split(unmarked, text.LINE_END), lambda r: F.when(F.substring(r, -1, 1).rlike(documents.TRAILING), F.rtrim(r, F.lit(BLANKS))).otherwise(r)), "\n")
    whole = read(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.concat(first, bare, F.lit("\nend\n")).alias("text"))
    return rules.all_failures(documents.line_hygiene(whole), documents.control_characters(documents.explode_lines(whole))).groupBy("rule_id").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT CAST(p_size AS VARCHAR) AS book, p_brand AS slug FROM part UNION SELECT CAST(s_nationkey AS VARCHAR), s_name FROM supplier")
def set3_namespace(spark, sf_dir):
    own = read(spark, sf_dir, "part").select(F.col("p_size").cast("string").alias("book"), F.col("p_brand").alias("slug"))
    return rules.namespace(own, read(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("string").alias("book"), F.col("s_name").alias("slug")))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS path, 'local' AS side FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 3 = 0 AND o_orderkey % 9 <> 0")
def set4_force_set(spark, sf_dir):
    path = F.concat("o_orderstatus", F.lit("/"), F.col("o_orderkey").cast("string"))
    o = read(spark, sf_dir, "orders")
    forced = o.where("o_orderkey % 3 = 0").select(path.alias("path"), F.lit("local").alias("side")).unionByName(o.where("o_orderkey % 9 = 0").select(path.alias("path"), F.lit("remote").alias("side")))
    return rules.force_set(o.select(path.alias("path")), forced, "O")


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'Untitled' ELSE p_name END AS title, 'CWE-' || p_size AS cwe, 'CWE:999,a b,' || lower(p_brand) AS tags, 'size:' || p_size || ',bare' AS local_tags, 'size=' || p_size || ',bare=' AS remote_tags,
 '<p>' || replace(p_name, '&', '&amp;') || '<br>&lt;b&gt;</p>' AS html, p_name || chr(10) || '<b>' AS entities FROM part""")
def rec2_canonical(spark, sf_dir):
    size = F.col("p_size").cast("string")
    known = F.transform(F.sequence(F.lit(1), F.lit(60)), lambda n: F.concat(F.lit("CWE-"), n.cast("string")))
    split = records.split_tags(F.array(F.lower("p_brand"), F.concat(F.lit("cwe-"), size), F.lit("a b"), F.concat(F.lit("CWE:"), size), F.lit("CWE:999")), known)
    pairs = F.array(F.struct(F.lit("size").alias("name"), size.alias("value")), F.struct(F.lit("bare").alias("name"), F.lit("").alias("value")))
    local = records.tags_to_local(pairs)
    html = records.entities_to_html(F.concat("p_name", F.lit("\n\n<b>\n")))
    return read(spark, sf_dir, "part").select(
        "p_partkey", records.canonical_title(F.when(F.col("p_partkey") % 3 == 0, "  ").otherwise(F.concat(F.lit(" "), "p_name", F.lit(" ")))).alias("title"), F.array_join(split["cwe"], ",").alias("cwe"), F.array_join(split["tags"], ",").alias("tags"),
        F.array_join(local, ",").alias("local_tags"), F.array_join(F.transform(records.tags_to_remote(local), lambda t: F.concat(t["name"], F.lit("="), t["value"])), ",").alias("remote_tags"), html.alias("html"), records.entities_from_html(html).alias("entities"),
    )


@query("""SELECT o_orderkey, 'sha256:' || sha256('{"note":' || CASE WHEN o_orderkey % 2 = 0 THEN 'null' ELSE '""' END || ',"o_custkey":' || o_custkey || '}') AS hash FROM orders""")
def rec1_fingerprint(spark, sf_dir):
    o = read(spark, sf_dir, "orders").withColumn("note", F.when(F.col("o_orderkey") % 2 == 1, ""))
    return o.select("o_orderkey", reconcile.fingerprint("o_custkey", "note").alias("hash"))


@query("SELECT o_orderstatus AS run_id, string_agg(verb || ' ' || n, ', ' ORDER BY verb) AS counts, any_value(kinds) AS kinds FROM (SELECT o_orderstatus, CASE o_orderkey % 3 WHEN 0 THEN 'push' WHEN 1 THEN 'delete-remote' ELSE 'move' END AS verb, count(*) AS n FROM orders GROUP BY ALL) JOIN (SELECT o_orderstatus, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS kinds FROM orders GROUP BY o_orderstatus) USING (o_orderstatus) GROUP BY o_orderstatus")
def agg17_snapshot_summary(spark, sf_dir):
    k = F.col("o_orderkey") % 3
    return records.snapshot_summary(read(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("run_id"), F.col("o_orderpriority").alias("kind"), F.when(k == 0, "PUSH").when(k == 1, "DELETE_REMOTE").otherwise("MOVE_EDIT").alias("outcome")))


@query("SELECT o_custkey AS run_id, CAST(max(CASE o_orderkey % 9 WHEN 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END WHEN 4 THEN 1 ELSE 0 END) AS INTEGER) AS exit_code FROM orders GROUP BY o_custkey")
def sca22_exit_code(spark, sf_dir):
    k = F.col("o_orderkey")
    return records.exit_code(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run_id"), F.when(k % 9 == 0, "SKIP").when(k % 9 == 4, "COLLISION").otherwise("PUSH").alias("outcome"), F.when(k % 2 == 0, "ATTENTION").otherwise("INFO").alias("severity")), "run_id")


@query(SLOTS + """, e AS (SELECT id, o1, CASE WHEN id % 3 = 0 THEN path WHEN id % 3 = 1 THEN 'remote ' || id ELSE kind || ' ' || id END AS subject, CASE WHEN id % 4 = 0 THEN 'INFO' WHEN id % 4 = 1 THEN 'ATTENTION' END AS severity FROM c WHERE o1 <> 'CLEAN')
SELECT lower(replace(o1, '_', '-')) AS verb, subject, 'would ' || lower(replace(o1, '_', '-')) || ' ' || subject || CASE WHEN id % 5 = 0 THEN ' — why' ELSE '' END AS line, severity FROM e WHERE severity IS DISTINCT FROM 'INFO'""")
def log3_events(spark, sf_dir):
    k = F.col("id")
    plan = reconcile.classify(slots(spark, sf_dir)).withColumns({
        "path": F.when(k % 3 == 0, F.col("path")), "label": F.when(k % 3 == 1, F.concat(F.lit("remote "), k.cast("string"))), "detail": F.when(k % 5 == 0, "why").otherwise(""), "severity": F.when(k % 4 == 0, "INFO").when(k % 4 == 1, "ATTENTION"),
    })
    return records.events(plan, dry_run=True)


@query("SELECT o_orderpriority AS phase, CAST(max(CAST(o_orderdate AS DATE)) AS VARCHAR) AS at, max_by(o_orderstatus, CAST(o_orderdate AS DATE)::VARCHAR || o_orderstatus) AS status FROM orders GROUP BY o_orderpriority")
def log4_last_run(spark, sf_dir):
    return records.last_run(read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("phase"), F.to_date("o_orderdate").cast("string").alias("at"), F.col("o_orderstatus").alias("status")))


@query("WITH f AS (SELECT o_orderkey AS doc_id, 'a/' || o_custkey || '/' || o_orderkey AS path FROM orders) SELECT doc_id, path FROM f WHERE path LIKE 'a/1/%' OR path LIKE 'a/23/%' OR path = 'a/' || (SELECT min(o_custkey) FROM orders) || '/' || (SELECT min(o_orderkey) FROM orders)")
def fil5_scope_filter(spark, sf_dir):
    f = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.concat_ws("/", F.lit("a"), F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string")).alias("path"), "o_custkey")
    some = read(spark, sf_dir, "orders").agg(F.min("o_custkey").alias("c"), F.min("o_orderkey").alias("o")).select(F.concat_ws("/", F.lit("a"), F.col("c").cast("string"), F.col("o").cast("string")).alias("path")).join(f.select("path"), "path", "left_semi")
    scopes = f.where("o_custkey in (1, 23)").select(F.concat(F.lit("a/"), F.col("o_custkey").cast("string")).alias("path")).distinct().unionByName(some)
    return documents.scope_filter(f.drop("o_custkey"), scopes, f.select("path"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'library' WHEN 1 THEN 'instance' WHEN 2 THEN 'inbox' END AS tier FROM orders")
def fil8_tier(spark, sf_dir):
    k = F.col("o_orderkey") % 4
    path = F.concat(F.when(k == 0, "findings/library/").when(k == 1, "findings/reports/r/").when(k == 2, "findings/inbox/").otherwise("methodology/library/"), F.col("o_orderkey").cast("string"), F.lit(".md"))
    return read(spark, sf_dir, "orders").select("o_orderkey", text.tier(path).alias("tier"))


@query(SLOTS + """, x AS (SELECT * FROM s WHERE id % 3 <> 0), i AS (SELECT path, kind, id FROM x WHERE b IS NOT NULL), lo AS (SELECT path, kind, l FROM x WHERE l IS NOT NULL), r AS (SELECT kind, id, r FROM x WHERE r IS NOT NULL),
sl AS (SELECT coalesce(lo.path, i.path) AS path, coalesce(i.kind, lo.kind) AS kind, i.id, l, i.id IS NOT NULL AS indexed FROM lo FULL JOIN i ON lo.path = i.path)
SELECT coalesce(sl.kind, r.kind) AS kind, coalesce(sl.id, r.id) AS id, path, l AS local_hash, r AS remote_hash, CASE WHEN coalesce(sl.id, r.id) % 5 <> 0 THEN 'o' END AS base_hash, coalesce(indexed, FALSE) AS indexed
FROM sl FULL JOIN r ON sl.kind = r.kind AND sl.id = r.id""")
def joi3_three_way(spark, sf_dir):
    s = slots(spark, sf_dir).where("id % 3 <> 0")
    state = s.where("id % 5 <> 0").select("kind", "id", F.lit("o").alias("base_hash"))
    out = reconcile.three_way_join(s.where("local_hash is not null").select("path", "kind", "local_hash"), s.where("base_hash is not null").select("path", "kind", "id"), s.where("remote_hash is not null").select("kind", "id", "remote_hash"), state)
    return out.select("kind", "id", "path", "local_hash", "remote_hash", "base_hash", "indexed")


@query("SELECT l_orderkey, l_linenumber, l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 10) AS resolved FROM lineitem")
def joi4_resolve_refs(spark, sf_dir):
    files = read(spark, sf_dir, "part").where("p_size > 10").select((F.col("p_partkey") % 10).alias("folder"), F.col("p_partkey").alias("filename"))
    refs = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 10).alias("folder"), F.col("l_partkey").alias("filename"))
    return lookups.resolve_refs(refs, files).select("l_orderkey", "l_linenumber", "resolved")


@query("""WITH i AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 1 + o_custkey ELSE o_custkey END AS report FROM orders WHERE o_orderkey % 3 <> 1),
n AS (SELECT o_custkey AS report, o_orderpriority AS name, min_by(o_orderkey, o_orderkey) AS id FROM orders WHERE o_orderkey % 2 = 0 GROUP BY ALL), k AS (SELECT n.report, name, n.id FROM n JOIN i ON n.id = i.id AND n.report = i.report)
SELECT o_orderkey, coalesce(i.id, k.id) AS id FROM orders LEFT JOIN i ON i.id = o_orderkey AND i.report = o_custkey LEFT JOIN k ON k.report = o_custkey AND k.name = o_orderpriority""")
def joi5_ref_ids(spark, sf_dir):
    """References by path or by name; every fifth record lies in another report's folder, every third in none."""
    o = read(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    path = F.concat(F.lit("evidence/"), key.cast("string"), F.lit(".png"))
    folder = F.when(key % 5 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")).cast("string")
    index = o.where(key % 3 != 1).select(F.concat(F.lit("findings/reports/"), folder, F.lit("/"), path).alias("path"), key.alias("id"))
    names = o.where(key % 2 == 0).select(F.col("o_custkey").alias("report"), F.col("o_orderpriority").alias("name"), key.alias("seq"), key.alias("id"))
    refs = o.select("o_orderkey", F.col("o_custkey").alias("report"), F.col("o_orderpriority").alias("name"), path.alias("path"))
    return lookups.resolve_ref_ids(refs, index, names).select("o_orderkey", "id")


#: Forms of links (%b the book, %d the number) and whether each is broken; even numbers are known as pages, those that 3 divides as chapters.
LINKS = [
    ("/books/%b/page/P%d", "page"), ("/books/%b/chapter/p%d/", "chapter"), ("https://wiki/books/%b/page/p%d?x#y", "page"), ("https://other/books/%b/page/p%d", None), ("x/books/%b/page/p%d", None), ("/books/%b/page/p%d/extra", None), ("/books/B%b/page/p%d", "always"), ("http://wiki/books/%b/chapter/P%d", "chapter"),
]


@query("WITH f AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{form}', {'NULL' if kind is None else repr(kind)})" for i, (form, kind) in enumerate(LINKS)) + """) v(i, form, kind))
SELECT page_id AS doc_id, replace(replace(form, '%d', page_id::VARCHAR), '%b', 'b' || page_id % 7) AS url FROM pages, f WHERE kind = 'always' OR kind = 'page' AND page_id % 2 <> 0 OR kind = 'chapter' AND page_id % 3 <> 0""")
def joi6_wiki007_internal_links(spark, sf_dir):
    k, n = F.col("page_id"), F.col("page_id").cast("string")
    book = F.concat(F.lit("b"), (k % 7).cast("string"))
    pages = read(spark, sf_dir, "pages")
    forms = F.explode(F.array(*[F.lit(f) for f, _ in LINKS])).alias("form")
    links = pages.select(k.alias("doc_id"), n.alias("n"), book.alias("b"), forms).select("doc_id", F.replace(F.replace("form", F.lit("%d"), F.col("n")), F.lit("%b"), F.col("b")).alias("url"))
    slugs = lambda kind, some: pages.where(some).select(book.alias("book"), F.lit(kind).alias("kind"), F.concat(F.lit("p"), n).alias("slug"))
    known = rules.namespace(slugs("page", k % 2 == 0), slugs("chapter", k % 3 == 0))
    return lookups.internal_link_check(links, known, "wiki").select("doc_id", "url")


@query("""WITH d AS (SELECT doc_id, doc_id % 50 AS n, text, doc_id % 2 = 0 AS known, CASE WHEN doc_id % 3 = 0 THEN '../images/' ELSE 'images/' END AS home FROM documents),
p AS (SELECT *, text || ' images/e' || n || '.png ' AS middle, CASE WHEN known THEN 'https://u/' || n ELSE 'images/' || n || '.png' END AS there, CASE WHEN known THEN 'https://u/' || n ELSE '../images/' || n || '.png' END AS deep FROM d)
SELECT doc_id, md5('![a](' || there || ' "t") ' || middle || '![b](' || deep || ')') AS remote_digest,
 md5('![a](' || CASE WHEN known THEN home || 'e' || n || '.png' ELSE there END || ' "t") ' || middle || '![b](' || CASE WHEN known THEN home || 'e' || n || '.png' ELSE deep END || ')') AS local_digest FROM p""")
def joi12_translate_urls(spark, sf_dir):
    n, known = (F.col("doc_id") % 50).cast("string"), F.when(F.col("doc_id") % 2 == 0, "e").otherwise("")
    said = F.concat(F.lit("![a](images/"), known, n, F.lit('.png "t") '), F.col("text"), F.lit(" images/e"), n, F.lit(".png ![b](../images/"), known, n, F.lit(".png)"))
    docs = read(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 3 == 0).alias("in_chapter"), said.alias("text"))
    gallery = docs.select(F.concat(F.lit("e"), n, F.lit(".png")).alias("name"), F.concat(F.lit("https://u/"), n).alias("url")).distinct()
    remote = lookups.translate_urls(docs, gallery)
    local = lookups.localise_urls(remote, gallery)
    return remote.select("doc_id", F.md5("text").alias("remote_digest")).join(local.select("doc_id", F.md5("text").alias("local_digest")), "doc_id")


@query("""SELECT o_orderkey AS id, o_orderkey % 4 = 0 OR o_orderkey % 6 = 0 OR o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 AS changed FROM orders""")
def joi11_changed_since_witness(spark, sf_dir):
    remote = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("updated_at"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderkey") % 9).alias("revision"))
    k = F.col("id")
    state = remote.where(k % 4 != 0).select("id", F.when(k % 6 != 0, "sha256:x").alias("base_hash"), F.when(k % 5 == 0, None).otherwise(F.col("updated_at")).alias("updated_at"), F.when(k % 7 == 0, 99).otherwise(F.col("revision")).alias("revision"))
    return reconcile.changed_since_witness(remote, state, ["updated_at", "revision"]).select("id", "changed")
