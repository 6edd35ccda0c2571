"""Registered queries of headers and of what a conversion loses, each beside its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from findlake.operators import documents, rules
from findlake.plans.queries import query, read

#: Headers of findings and what must be told of them: text, rule, message. ``%d`` is the document's id.
FINDINGS = [
    ("severity: high\nfinding_type: web\nowner: x\n", "FND-001", "owner"), ("finding_type: web # no severity\n", "FND-002", "severity"), ("severity: 'urgent'\nfinding_type: web\n", "FND-003", "urgent"), ("severity: high\nfinding_type: \"other\"\n", "FND-004", "other"),
    ("severity: high\nfinding_type: web\ncvss:\n  vector: AV:N\n", "FND-005", "no prefix"), ("severity: high\nfinding_type: web\ncwe:\n  - CWE-79\n  - CWE-999999\n", "FND-006", "CWE-999999"), ("severity: high\nfinding_type: web\ntags: [a, 'A']\n", "FND-007", "repeated tag"),
    ("severity: high\nfinding_type: web\naffected_entities: |\n  host\n  other\n", "FND-008", "affected entities on a library finding"), ("severity: low\nseverity: high\nfinding_type: web\ncwe: [79]\ntags:\n  - a\n", None, None),
]


def with_header(spark, sf_dir, headers, name="documents"):
    """Whole texts behind a header each, of several by turns; the id is ``doc_id``."""
    k = F.col("doc_id") % len(headers)
    header = F.element_at(F.array(*[F.lit(h) for h in headers]), (k + 1).cast("int"))
    return read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("---\n"), header, F.lit("---\n"), F.coalesce("text", F.lit(""))).alias("text"))


@query("WITH r AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{rule}', '{message}')" for i, (_, rule, message) in enumerate(FINDINGS) if rule) + f""") v(i, rule_id, message))
SELECT rule_id, doc_id, CAST(NULL AS INTEGER) AS line, message FROM documents JOIN r ON doc_id % {len(FINDINGS)} = i""")
def fnd001_008_headers(spark, sf_dir):
    """The rules on findings' fields, from the texts of the documents behind headers of every kind."""
    docs = with_header(spark, sf_dir, [h for h, *_ in FINDINGS])
    known = read(spark, sf_dir, "part").select(F.lit(79).alias("cwe_id"))
    return documents.frontmatter_rules(documents.finding_headers(docs.withColumn("tier", F.lit("library"))), known)


#: Headers of every form, the fields and lists that they hold, repeated keys, and what can't be read.
HEADERS = [
    ("a: 1\nb: 'it''s' # c\nc: \"x # y\"\n", "a=1,b=it''s,c=x # y", "", "", None), ("l:\n  - 'p'\n  - q # r\nm: [s, \"t, u\"]\n", "l=,m=", "l:p/q,m:s/t, u", "", None), ("c:\n  v: x:y\n  n: 'q'\ns: 1\ns: 2\n", "c.n=q,c.v=x:y,c=,s=2", "", "s", None),
    ("# note\nt: |\n  one\n   two\n\nf: >\n  a\n  b\np: long\n  line\n", "f=a b,p=long line,t=one\n two", "", "", None), ("oops\na: 1\n", "a=1", "", "", "not a field: oops"), ("a: 'open\nb: ~\n", "a=''open,b=", "", "", "a: open quote"),
    ("a: [1\n", "a=[1", "", "", "a: open bracket"), ("a: {x: 1}\n", "a={x: 1}", "", "", "a: unread form"), ("a:\n\t- x\n", "a=", "a:x", "", "a: indent by tab"), ("", "", "", "", None),
]


@query("WITH r AS (SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("\n", "' || chr(10) || '") + "'" for v in (i, *row[1:])) + ")" for i, row in enumerate(HEADERS)) + f""") v(i, fields, lists, repeated, error))
SELECT doc_id, fields, lists, repeated, error FROM documents JOIN r ON doc_id % {len(HEADERS)} = i""")
def doc2_header_fields(spark, sf_dir):
    docs = documents.frontmatter_split(with_header(spark, sf_dir, [h for h, *_ in HEADERS]))
    told = docs.select("doc_id", documents.header_fields(F.col("header")).alias("h"))
    listed = lambda m, value: F.array_join(F.array_sort(F.transform(F.map_entries(m), value)), ",")
    return told.select(
        "doc_id", listed(F.col("h.fields"), lambda e: F.concat(e["key"], F.lit("="), e["value"])).alias("fields"), listed(F.col("h.lists"), lambda e: F.concat(e["key"], F.lit(":"), F.array_join(e["value"], "/"))).alias("lists"),
        F.array_join("h.repeated", ",").alias("repeated"), F.col("h.error").alias("error"),
    )


@query("WITH r AS (SELECT * FROM (VALUES (0, 'WIKI-001', 'owner'), (1, 'WIKI-002', 'no title'), (2, 'WIKI-003', 'soon')) v(i, rule_id, message)) SELECT rule_id, doc_id, CAST(NULL AS INTEGER) AS line, message FROM documents JOIN r ON doc_id % 4 = i")
def wiki001_003_headers(spark, sf_dir):
    """The rules on pages' fields, from the texts of the documents behind headers."""
    docs = with_header(spark, sf_dir, ["title: T\nowner: x\n", "title: ' '\n", "title: T\npriority: soon\n", "title: \"T\"\npriority: -12\ntags: [a]\n"])
    fields = documents.frontmatter_split(docs).select("doc_id", documents.header_fields(F.col("header"))["fields"].alias("fields"))
    return rules.page_frontmatter_rules(fields)


ALLOWED = ", ".join(f"'{t}'" for t in documents.KEPT_TAGS)
KEPT = ", ".join(f"'{t}@{a}'" for t, names in documents.KEPT_ATTRIBUTES.items() for a in names)
SQL_TAG = r"""<([A-Za-z][A-Za-z0-9-]*)((?:[^<>"''/]|/[^>]|"[^"]*"|''[^'']*'')*)/?>"""


@query(rf"""WITH p AS (SELECT page_id AS doc_id, regexp_replace(regexp_replace(regexp_replace(html || '<p class=x onclick="a>b">t<br/><font size=''2''>u</font>', '(?s)<!--.*?-->', '', 'g'), '(?is)(<script[^>]*>).*?(</script\s*>)', '', 'g'), '(?is)(<style[^>]*>).*?(</style\s*>)', '', 'g') AS h FROM pages),
m AS (SELECT doc_id, unnest(regexp_extract_all(h, '{SQL_TAG}')) AS m FROM p), t AS (SELECT doc_id, lower(regexp_extract(m, '{SQL_TAG}', 1)) AS tag, regexp_extract(m, '{SQL_TAG}', 2) AS rest FROM m),
a AS (SELECT doc_id, tag, lower(unnest(regexp_extract_all(rest, '([^\s=<>"''/]+)(?:\s*=\s*(?:"[^"]*"|''[^'']*''|[^\s"''<>]+))?', 1))) AS attribute FROM t WHERE tag IN ({ALLOWED})),
d AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT tag || '@' || attribute, ',' ORDER BY tag || '@' || attribute) AS names FROM a WHERE tag || '@' || attribute NOT IN ({KEPT}) GROUP BY doc_id)
SELECT t.doc_id, count(*) AS n_tags, count(*) FILTER (tag NOT IN ({ALLOWED})) AS n_outside, coalesce(string_agg(DISTINCT tag, ',' ORDER BY tag) FILTER (tag NOT IN ({ALLOWED})), '') AS outside, coalesce(any_value(d.n), 0) AS n_dropped, coalesce(any_value(d.names), '') AS dropped
FROM t LEFT JOIN d USING (doc_id) GROUP BY t.doc_id""")
def doc7_html_losses(spark, sf_dir):
    """The loss report of whole pages, an unknown element and dropped attributes planted at their end."""
    pages = read(spark, sf_dir, "pages").select("page_id", F.concat("html", F.lit("""<p class=x onclick="a>b">t<br/><font size='2'>u</font>""")).alias("html"))
    return documents.html_losses(pages, "page_id", "html")
