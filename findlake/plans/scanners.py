"""Registered queries of the scanner sources: exports are written from the events, eight a file, and parsed; the twins tell from the events what must come out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from findlake.operators.numbering import scratch_folder
from findlake.plans.queries import query, read
from findlake.sources import scans

A_FILE = 8
EVENTS = "e AS (SELECT event_id AS n, event_type AS t, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"
TEXTS = ["title", "cvss_vector", "cwe", "description", "impact", "mitigation", "references", "steps", "tags", "notes"]


def numbers() -> tuple[Column, Column]:
    """An event's own number and the number in its properties."""
    return F.col("event_id"), F.get_json_object("props", "$.k").cast("long")


def join(*parts: Column | str | None) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def tag(name: str, value: Column | str, attributes: Column | str = "") -> Column:
    return join(f"<{name}", attributes, ">", value, f"</{name}>")


def only(condition: Column, value: Column | str) -> Column:
    return F.when(condition, value).otherwise("")


def pick(number: Column, *values: str) -> Column:
    """The value at ``number`` modulo their count."""
    return F.element_at(F.array(*map(F.lit, values)), (number % len(values) + 1).cast("int"))


def reports(spark: SparkSession, sf_dir: str, items: list[Column], wrap: Callable, between: str = "") -> DataFrame:
    """``path, text``: a file of eight events; ``wrap(file number, text of the first items, ...)`` puts their items together."""
    n = F.col("event_id")
    each = read(spark, sf_dir, "events").select(F.floor(n / A_FILE).alias("file"), F.struct(n.alias("n"), *[x.alias(f"x{i}") for i, x in enumerate(items)]).alias("x"))
    bodies = each.groupBy("file").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    texts = [F.array_join(F.col("xs")[f"x{i}"], between) for i in range(len(items))]
    return bodies.select(F.col("file").cast("string").alias("path"), wrap(F.col("file"), *texts).alias("text"))


def told(raw: DataFrame) -> DataFrame:
    found = scans.findings(raw)
    return found.select("scan_id", "key", "sev_rank", *[F.array_join(c, "|").alias(c) if c in ("tags", "notes") else c for c in TEXTS], F.array_join("components", "|").alias("components"))


def twin(where: str = "true", confidence: str = "-1", scale: str = "['']", pos: str = "n", component: str = "''", **columns: str) -> str:
    """SQL of findings from an occurrence's columns, one an event; ``key`` and ``sev_rank`` are to be among them."""
    texts = {c: columns.get(c, "''") for c in TEXTS}
    said = ", ".join(f"{v} AS \"{c}\"" for c, v in texts.items())
    firsts = ", ".join(f"arg_min(\"{c}\", pos) AS \"{c}\"" for c in TEXTS if c != "tags")
    return f"""WITH {EVENTS}, o AS (SELECT CAST(n // {A_FILE} AS VARCHAR) AS scan_id, {pos} AS pos, {columns['key']} AS key, {columns['sev_rank']} AS r, {component} AS component, {confidence} AS conf, {said} FROM e WHERE {where}),
c AS (SELECT scan_id, key, component, min(pos) AS p FROM o WHERE component <> '' GROUP BY ALL), l AS (SELECT scan_id, key, string_agg(component, '|' ORDER BY p) AS components FROM c GROUP BY ALL),
f AS (SELECT scan_id, key, CAST(max(r) AS INTEGER) AS sev_rank, {firsts}, CASE WHEN max(conf) < 0 THEN arg_min(tags, pos) ELSE 'confidence:' || {scale}[max(conf) + 1] END AS tags FROM o GROUP BY ALL)
SELECT f.*, coalesce(components, '') AS components FROM f LEFT JOIN l USING (scan_id, key)"""


def link(url: str, label: str | None = None) -> str:
    return f"'<li><a href=\"' || {url} || '\">' || {label or url} || '</a></li>'"


V2 = "AV:L/AC:M/Au:S/C:P/I:N/A:C"
V31 = "'CVSS:3.1/AV:L/AC:H/PR:L/UI:N/S:U/C:L/I:N/A:H'"
LOST = "'CVSS v2 vector nonsense could not be converted, dropped'"


@query(twin(
    where="n % 7 <> 0", key="'p' || k % 5", sev_rank="[0, 1, 2, 3, 4, 0][k % 6 + 1]", component="'h' || n // 8 || ':' || k || CASE WHEN n % 3 = 0 THEN '/udp' ELSE '/tcp' END || CASE WHEN k % 2 = 0 THEN ' (www)' ELSE '' END",
    title="CASE WHEN k % 5 = 0 THEN 'Plugin p0' ELSE 'Check ' || k % 5 END", cvss_vector=f"CASE k % 4 WHEN 0 THEN 'CVSS:3.0/AV:N' WHEN 1 THEN {V31} ELSE '' END", notes=f"CASE WHEN k % 4 = 2 THEN {LOST} ELSE '' END",
    cwe="CASE WHEN k % 3 = 0 THEN 'CWE-79' ELSE '' END", description="CASE WHEN k % 2 = 0 THEN 'S' || chr(10) || chr(10) ELSE '' END || 'D & ' || k", mitigation="'Fix'",
    references="'<ul>' || " + link("'http://a/' || k") + " || '<li>b</li></ul>'",
))
def ing1_nessus(spark, sf_dir):
    n, k = numbers()
    item = tag("ReportItem", join(
        tag("risk_factor", pick(k, "None", "Low", "Medium", "High", "Critical", "odd")), only(k % 4 == 0, tag("cvss3_vector", "AV:N")), only(k % 4 < 2, tag("cvss_vector", f"CVSS2#{V2}")), only(k % 4 == 2, tag("cvss_vector", "nonsense")),
        only(k % 3 < 2, tag("cwe", pick(k, "79", "CWE-0", ""))), only(k % 2 == 0, tag("synopsis", "S")), tag("description", join("D &amp; ", k)), tag("solution", "Fix"), tag("see_also", join("http://a/", k, "\n b ")), only(n % 7 == 0, tag("snoozed", "1")),
    ), join(' pluginID="p', k % 5, '"', only(k % 5 != 0, join(' pluginName="Check  ', k % 5, '"')), only(k % 2 == 0, ' svc_name="www"'), ' port="', k, '"', only(n % 3 == 0, ' protocol="udp"')))
    files = reports(spark, sf_dir, [item], lambda file, body: tag("NessusClientData_v2", tag("Report", tag("ReportHost", body, join(' name="h', file, '"')))))
    return told(scans.nessus_occurrences(files, drop_snoozed=True))


@query(twin(
    where="k % 6 <> 4", key="'b' || k % 4", sev_rank="[3, 2, 1, 0, 0, 0][k % 6 + 1]", confidence="[2, 1, 0, -1][n % 4 + 1]", scale="['tentative', 'firm', 'certain']",
    component="CASE WHEN n % 3 = 0 THEN '10.0.0.1' ELSE 'http://h' END || CASE WHEN k % 2 = 0 THEN '/p [' || k || ']' ELSE '/p' END || CASE WHEN n % 3 = 1 THEN ' (10.0.0.1)' ELSE '' END",
    title="CASE WHEN k % 4 = 3 THEN 'Unknown' ELSE 'Issue ' || k % 4 END", description="CASE WHEN k % 2 = 0 THEN 'B' || chr(10) || chr(10) ELSE '' END || 'D' || k", mitigation="'R'",
    references="'<ul>' || " + link("'http://r/' || k", "'one &amp;amp; two'") + " || " + link("'http://s'") + " || '</ul>'",
))
def ing2_burp(spark, sf_dir):
    n, k = numbers()
    host = F.when(n % 3 == 0, '<host ip="10.0.0.1"></host>').when(n % 3 == 1, '<host ip="10.0.0.1">http://h</host>').otherwise("<host>http://h</host>")
    issue = tag("issue", join(
        tag("type", join("b", k % 4)), only(k % 4 != 3, tag("name", join("Issue  ", k % 4))), host, tag("path", "/p"), only(k % 2 == 0, tag("location", join("/p [", k, "]"))),
        tag("severity", pick(k, "High", "Medium", "Low", "Information", "False positive", "odd")), tag("confidence", pick(n, "Certain", "Firm", "Tentative", "odd")), only(k % 2 == 0, tag("issueBackground", "B")), tag("issueDetail", join("D", k)),
        tag("remediationBackground", "R"), tag("references", join('<![CDATA[<ul><li><a href="http://r/', k, '">one &amp; two</a></li><li><A HREF=\'http://s\' rel="x"> </A></li></ul>]]>')),
    ))
    return told(scans.burp_occurrences(reports(spark, sf_dir, [issue], lambda _, body: tag("issues", body, ' burpVersion="1"'))))


@query(twin(
    key="'z' || k % 3", sev_rank="CASE WHEN k % 2 = 0 THEN k % 4 ELSE 3 END", confidence="[0, 1, 2, 3, -1][n % 5 + 1]", scale="['false-positive', 'low', 'medium', 'high']", component="CASE WHEN k % 3 = 0 THEN '' ELSE 'u' || k END",
    title="'Alert ' || k % 3", cwe="['CWE-79', '', ''][k % 3 + 1]", description="'D' || k", mitigation="'Fix'", references="'<ul>' || " + link("'http://a'") + " || " + link("'http://b/' || k") + " || '</ul>'",
    steps="CASE WHEN k % 3 = 0 THEN '' ELSE '<ul><li>u' || k || ' [POST]' || CASE WHEN k % 2 = 0 THEN ' param: <code>&lt;q&gt;</code>' ELSE '' END || '</li><li> [GET]</li></ul>' END",
))
def ing3_zap(spark, sf_dir):
    n, k = numbers()
    risk, text = pick(k, "0", "1", "2", "3"), {"alertRef": join("z", k % 3), "confidence": pick(n, "0", "1", "2", "3", "x"), "cweid": pick(k, "79", "-1", "0"), "desc": join("D", k), "solution": F.lit("Fix")}
    plain = lambda name, value: join(f'"{name}":"', value, '"')
    in_json = join("{", F.concat_ws(",", *[plain(c, v) for c, v in text.items()], plain("name", join("Alert ", k % 3)), plain("reference", join("http://a\\n\\nhttp://b/", k)), F.when(k % 2 == 0, plain("riskcode", risk)).otherwise(plain("riskdesc", "High (Medium)")), F.when(
        k % 3 != 0, join('"instances":[{', plain("uri", join("u", k)), ',"method":"POST"', only(k % 2 == 0, ',"param":"<q>"'), '},{"uri":""}]'))), "}")
    in_xml = tag("alertitem", join(
        *[tag(c, v) for c, v in text.items()], tag("alert", join("Alert  ", k % 3)), tag("reference", join("http://a\n\nhttp://b/", k)), F.when(k % 2 == 0, tag("riskcode", risk)).otherwise(tag("riskdesc", "High (Medium)")),
        only(k % 3 != 0, tag("instances", join(tag("instance", join(tag("uri", join("u", k)), tag("method", "POST"), only(k % 2 == 0, tag("param", "&lt;q&gt;")))), tag("instance", tag("uri", ""))))),
    ))
    wrap = lambda file, j, x: F.when(file % 2 == 0, join('{"@version":"2","site":[{"alerts":[', j, "]}]}")).otherwise(tag("OWASPZAPReport", tag("site", tag("alerts", F.regexp_replace(x, "</alertitem>,<", "</alertitem><")))))
    return told(scans.zap_occurrences(reports(spark, sf_dir, [in_json, in_xml], wrap, ",")))


@query(twin(
    key="CASE WHEN k % 4 = 0 THEN 'Name ' || k ELSE 'v' || k % 4 END", sev_rank="[0, 1, 2, 3, 4, 3, 0][k % 7 + 1]", component="'http://s' || CASE WHEN k % 2 = 0 THEN '/' || k ELSE '' END",
    title="CASE WHEN k % 4 = 1 THEN 'Finding v1' ELSE 'Name ' || k END", cvss_vector="CASE WHEN k % 2 = 0 THEN 'CVSS:3.1/AV:N' ELSE '' END", cwe="['CWE-89', 'CWE-79', ''][k % 3 + 1]", description="'D' || k", impact="'I'", mitigation="'R'",
    references="CASE WHEN k % 2 = 0 THEN '<ul><li>cve-2020-' || k || '</li>' ELSE '<ul>' END || " + link("'http://r'") + " || '</ul>'", tags="CASE WHEN k % 2 = 0 THEN 'cve-2020-' || k || '|sql' ELSE 'sql' END",
    notes="CASE WHEN k % 6 = 3 THEN 'only a CVSS v4 vector was present, dropped (v4 not supported in workspace format 2)' ELSE '' END",
))
def ing4_acunetix(spark, sf_dir):
    n, k = numbers()
    item = tag("ReportItem", join(
        only(k % 4 != 1, tag("Name", join("Name ", k))), only(k % 4 != 0, tag("VulnID", join("v", k % 4))), tag("Severity", pick(k, "0", "1", "2", "3", "4", "High", "odd")), only(k % 2 == 0, tag("AffectedItem", join("/", k))),
        tag("Description", join("D", k)), tag("Impact", "I"), tag("Recommendation", "R"), F.when(k % 3 == 0, '<CWEList><CWE id="89">CWE-89</CWE></CWEList>').when(k % 3 == 1, "<CWE>79</CWE>").otherwise(""),
        tag("Tags", join(only(k % 2 == 0, tag("Tag", join("cve-2020-", k))), "<Tag>sql</Tag>")), "<References><Reference>http://r</Reference></References>", only(k % 2 == 0, "<CVSS3><Descriptor>CVSS:3.1/AV:N</Descriptor></CVSS3>"),
        only(k % 3 == 0, "<CVSS4><Descriptor>CVSS:4.0/AV:N</Descriptor></CVSS4>"),
    ))
    return told(scans.acunetix_occurrences(reports(spark, sf_dir, [item], lambda _, body: tag("ScanGroup", tag("Scan", join(tag("StartURL", "http://s"), tag("ReportItems", body)))))))


@query(twin(
    where="n % 9 <> 0 AND k >= 50", key="'o' || k % 4", sev_rank="[4, 2, 0, 0, 1, 3][k % 6 + 1]", component="CASE WHEN n % 2 = 0 THEN 'web' ELSE '10.0.0.1' END || CASE WHEN k % 3 = 0 THEN ':80/tcp' ELSE '' END",
    title="CASE WHEN k % 4 = 0 THEN 'o0' ELSE 'Test ' || k % 4 END", cvss_vector=f"[{V31}, 'CVSS:3.1/AV:N', '', ''][k % 4 + 1]", notes=f"CASE WHEN k % 4 = 2 THEN {LOST} ELSE '' END", description="CASE WHEN k % 5 = 0 THEN 'D' ELSE 'S' || k END", impact="'J'",
    mitigation="'Fix'", references="'<ul><li>CVE-' || k || '</li>' || " + link("'http://u'") + " || '</ul>'",
))
def ing5_openvas(spark, sf_dir):
    n, k = numbers()
    words = F.concat_ws("|", F.when(k % 5 != 0, join("summary=S", k)), F.when(k % 4 != 3, join("cvss_base_vector=", pick(k, V2, "CVSS:3.1/AV:N", "nonsense", ""))), F.lit("impact=I"), F.lit(" impact = J "), F.lit("solution=Fix"))
    result = tag("result", join(
        tag("host", join("10.0.0.1", only(n % 2 == 0, "<hostname>web</hostname>"))), tag("port", pick(k, "80/tcp", "general/TCP", "")), tag("severity", pick(k, "9.8", "5.0", "0.0", "odd", "3.9", "7.0")), tag("qod", tag("value", k)), tag("description", "D"),
        tag("nvt", join(only(k % 4 != 0, tag("name", join("Test  ", k % 4))), tag("tags", words), tag("refs", join('<ref type="cve" id="CVE-', k, '"/><ref type="other" id="x"/><ref type="url" id="http://u"/>'))), only(n % 9 != 0, join(' oid="o', k % 4, '"'))),
    ))
    # a response's further reports aren't read
    later = '<result><severity>9.9</severity><qod><value>99</value></qod><nvt oid="o1"><name>later</name></nvt></result>'
    wrap = lambda file, body: F.when(file % 3 == 0, tag("report", tag("results", body), ' id="1"')).when(file % 3 == 1, tag("report", tag("report", tag("results", body)), ' id="1"')).otherwise(tag("get_reports_response", join(tag("report", tag("report", tag("results", body))), tag("report", tag("report", tag("results", later))))))
    return told(scans.openvas_occurrences(reports(spark, sf_dir, [result], wrap), min_qod=50))


@query(twin(
    key="'q' || k % 3", sev_rank="[0, 0, 1, 2, 3, 4][k % 6 + 1]", component="'10.0.0.' || k", title="CASE WHEN k % 3 = 0 THEN 'QID q0' ELSE 'Title ' || k % 3 END", description="'C' || k", impact="'D'", mitigation="'Fix'",
    references="'<ul>' || CASE WHEN k % 2 = 0 THEN " + link("'http://c/' || k", "'CVE-' || k") + " ELSE '<li>CVE-' || k || '</li>' END || '</ul>'",
))
def ing7_qualys_scan(spark, sf_dir):
    n, k = numbers()
    vuln = tag("VULN", join(only(k % 3 != 0, tag("TITLE", join("Title  ", k % 3))), tag("CONSEQUENCE", join("C", k)), tag("DIAGNOSIS", "D"), tag("SOLUTION", "Fix"), tag("CVE_ID_LIST", tag("CVE_ID", join(tag("ID", join("CVE-", k)), only(k % 2 == 0, tag("URL", join("http://c/", k))))))), join(' number="q', k % 3, '" severity="', k % 6, '"'))
    ip = tag("IP", tag("VULNS", tag("CAT", vuln)), join(F.when(n % 2 == 0, ' value="').otherwise(' addr="'), "10.0.0.", k, '"'))
    return told(scans.qualys_occurrences(reports(spark, sf_dir, [ip], lambda _, body: tag("SCAN", body))))


@query(twin(
    pos="(n % 2) * 8 + n % 8", key="'q' || k % 4", sev_rank="[3, 0, 2, 2][k % 4 + 1]", component="CASE WHEN n % 2 = 0 THEN 'http://w/' || k ELSE '' END", title="['Web ' || n // 8, 'QID q1', 'Two', 'QID q3'][k % 4 + 1]",
    cvss_vector="CASE WHEN k % 4 = 0 THEN 'CVSS:3.0/AV:N' ELSE '' END", description="CASE WHEN k % 4 = 0 THEN 'D' ELSE '' END", impact="CASE WHEN k % 4 = 0 THEN 'I' ELSE '' END", mitigation="CASE WHEN k % 4 = 0 THEN 'Fix' ELSE '' END",
    references="CASE WHEN k % 4 = 0 THEN '<ul><li>CVE-' || n // 8 || '</li></ul>' ELSE '' END",
))
def ing6_qualys_was(spark, sf_dir):
    n, k = numbers()
    glossary = lambda file: join(
        tag("QID", join(tag("QID", "q0"), tag("TITLE", join("Web ", file)), tag("SEVERITY", "4"), tag("DESCRIPTION", "D"), tag("IMPACT", "I"), tag("SOLUTION", "Fix"), tag("CVSS_V3", tag("VECTOR_STRING", "AV:N")), tag("CVE_LIST", tag("CVE", tag("ID", join("CVE-", file)))))),
        tag("QID", join(tag("QID", "q1"), tag("SEVERITY", "5"), tag("GROUP", "IG-DIAGX"))), tag("QID", join(tag("QID", "q2"), tag("TITLE", "Two"))),
    )
    items = [F.when(n % 2 == 0, tag("VULNERABILITY", join(tag("QID", join("q", k % 4)), tag("URL", join("http://w/", k))))), F.when(n % 2 == 1, tag("INFORMATION_GATHERED", tag("QID", join("q", k % 4))))]
    wrap = lambda file, found, gathered: tag("WAS_SCAN_REPORT", join(tag("GLOSSARY", tag("QID_LIST", glossary(file))), tag("RESULTS", join(tag("VULNERABILITY_LIST", found), tag("INFORMATION_GATHERED_LIST", gathered)))))
    return told(scans.qualys_occurrences(reports(spark, sf_dir, items, wrap)))


@query(twin(
    where="k % 5 <> 4", key="'q' || k % 5", sev_rank="[1, 2, 2, 2][k % 5 + 1]", component="CASE WHEN k % 2 = 0 THEN 'dns' ELSE '1.1.1.1' END || CASE WHEN k % 3 = 0 THEN '' ELSE ':' || k END", title="['Host ' || n // 8, 'QID q1', 'QID q2', 'QID q3'][k % 5 + 1]",
    cvss_vector="CASE WHEN k % 5 = 0 THEN 'CVSS:3.0/AV:N/AC:H' ELSE '' END", description="CASE WHEN k % 5 = 0 THEN 'T' ELSE '' END", impact="CASE WHEN k % 5 = 0 THEN 'I' ELSE '' END", mitigation="CASE WHEN k % 5 = 0 THEN 'Fix' ELSE '' END",
    references="CASE WHEN k % 5 = 0 THEN '<ul><li>CVE-1</li>' || " + link("'http://v'", "'V-1'") + " || '</ul>' ELSE '' END",
))
def ing8_qualys_vm(spark, sf_dir):
    n, k = numbers()
    host = tag("HOST", join(tag("IP", "1.1.1.1"), only(k % 2 == 0, tag("DNS", "dns")), tag("VULN_INFO_LIST", tag("VULN_INFO", join(only(k % 5 != 4, tag("QID", join("q", k % 5))), only(k % 3 != 0, tag("PORT", k)))))))
    glossary = lambda file: join(
        tag("VULN_DETAILS", join(tag("QID", "q0"), tag("TITLE", join("Host ", file)), tag("SEVERITY", "2"), tag("THREAT", "T"), tag("IMPACT", "I"), tag("SOLUTION", "Fix"), tag("CVSS3_SCORE", tag("CVSS3_BASE", "9.0 (AV:N/AC:H)")), tag("CVE_ID_LIST", tag("CVE_ID", tag("ID", "CVE-1"))),
                                tag("VENDOR_REFERENCE_LIST", tag("VENDOR_REFERENCE", join(tag("ID", "V-1"), tag("URL", "http://v")))))),
        tag("VULN_DETAILS", join(tag("QID", "q1"), tag("CVSS3_SCORE", tag("CVSS3_BASE", "9.0")))),
    )
    return told(scans.qualys_occurrences(reports(spark, sf_dir, [host], lambda file, body: tag("ASSET_DATA_REPORT", join(tag("HOST_LIST", body), tag("GLOSSARY", tag("VULN_DETAILS_LIST", glossary(file))))))))


CHECKS = [
    ("k % 4 = 0", "sslyze:ssl_2_0", "SSL 2.0 Enabled", 4), ("k % 5 = 0", "sslyze:ssl_3_0", "SSL 3.0 Enabled (POODLE)", 3), ("k % 3 = 0 AND k % 2 = 0", "sslyze:tls_1_0", "TLS 1.0 Enabled", 2), ("k % 7 = 0", "sslyze:heartbleed", "Heartbleed (CVE-2014-0160)", 4),
    ("k % 3 = 1", "sslyze:robot", "ROBOT Attack", 3), ("k % 11 = 0", "sslyze:openssl_ccs", "OpenSSL CCS Injection (CVE-2014-0224)", 3), ("k % 13 = 0", "sslyze:tls_compression", "TLS Compression Enabled (CRIME)", 2), ("k % 2 = 0", "sslyze:cert_expired", "Expired TLS Certificate", 3),
    ("k % 2 = 1", "sslyze:cert_hostname_mismatch", "TLS Certificate Hostname Mismatch", 2), ("k % 3 = 2", "sslyze:cert_untrusted", "Untrusted or Self-Signed TLS Certificate", 2), ("k % 4 < 2", "sslyze:cert_weak_key", "Weak TLS Certificate Public Key", 2),
]


@query("WITH " + EVENTS + ", h AS (" + " UNION ALL ".join(f"SELECT n, k, '{key}' AS key, '{title}' AS title, {rank} AS r FROM e WHERE {when}" for when, key, title, rank in CHECKS) + f"""),
c AS (SELECT CAST(n // {A_FILE} AS VARCHAR) AS scan_id, key, title, r, CASE WHEN n % 2 = 0 THEN 'host' ELSE '10.0.0.1' END || CASE WHEN n % 4 < 3 THEN ':' || k ELSE ':443' END AS component, min(n) AS p FROM h WHERE n % 6 <> 5 GROUP BY ALL)
SELECT scan_id, key, any_value(title) AS title, CAST(max(r) AS INTEGER) AS sev_rank, string_agg(component, '|' ORDER BY p) AS components FROM c GROUP BY scan_id, key""")
def ing9_sslyze(spark, sf_dir):
    n, k = numbers()
    flag = lambda condition: condition.cast("string")
    done = lambda name, body, status="COMPLETED": join(f'"{name}":{{"status":"', status, '","result":{', body, "}}")
    suites = lambda name, hit, status="COMPLETED": done(name, join('"accepted_cipher_suites":[', only(hit, '{"a":1}'), "]"), status)
    key = F.when(k % 4 == 0, '"RSA","key_size":1024').when(k % 4 == 1, '"EC","key_size":192').when(k % 4 == 2, '"RSA","key_size":2048').otherwise('"EC","key_size":256')
    deployment = join('"certificate_deployments":[{"leaf_certificate_is_within_validity_period":', flag(k % 2 != 0), ',"leaf_certificate_subject_matches_hostname":', flag(k % 2 == 0), ',"path_validation_results":[{"verified_certificate_chain":', F.when(k % 3 == 2, "null").otherwise("[1]"),
                      '}],"received_chain":[{"public_key":{"algorithm":', key, "}}]}]")
    checks = F.concat_ws(",", suites("ssl_2_0_cipher_suites", k % 4 == 0), suites("ssl_3_0_cipher_suites", k % 5 == 0), suites("tls_1_0_cipher_suites", k % 3 == 0, F.when(k % 2 == 0, "COMPLETED").otherwise("ERROR")), suites("tls_1_1_cipher_suites", F.lit(False)),
                         done("heartbleed", join('"is_vulnerable_to_heartbleed":', flag(k % 7 == 0))), done("robot", join('"robot_attack_enum":"', pick(k, "NOT_VULNERABLE", "VULNERABLE_WEAK_ORACLE", "UNKNOWN"), '"')), done("openssl_ccs_injection", join('"is_vulnerable_to_ccs_injection":', flag(k % 11 == 0))),
                         done("tls_compression", join('"supports_compression":', flag(k % 13 == 0))), done("certificate_info", deployment))
    place = join('"server_location":{', F.when(n % 2 == 0, '"hostname":"host",').otherwise('"hostname":"",'), '"ip_address":"10.0.0.1"', only(n % 4 < 3, join(',"port":', k)), "}")
    server = join("{", '"scan_status":"', F.when(n % 6 == 5, "ERROR").otherwise("COMPLETED"), '",', place, ',"scan_result":{', checks, "}}")
    files = reports(spark, sf_dir, [server], lambda _, body: join('{"server_scan_results":[', body, "]}"), ",")
    return told(scans.sslyze_occurrences(files)).select("scan_id", "key", "title", "sev_rank", "components")


#: Forms of a file: how its text is written, the text, and what must be told of it.
FORMS = [
    ("utf8", "<NessusClientData_v2/>", "nessus", "ok", None), ("bom", "<issues burpVersion=\"1\"/>", "burp", "ok", None), ("blank", "<?xml version=\"1.0\"?><!-- x --><SCAN/>", "qualys", "ok", None), ("utf16le", "<OWASPZAPReport/>", "zap", "ok", None),
    ("utf16be", "<report id=\"1\"/>", "openvas", "ok", None), ("odd", "<a/>", None, "encoding error", "not UTF-16LE"), ("lone", "<a/>", None, "encoding error", "not UTF-16BE"), ("utf8", "<issues/>", None, "unrecognised", None), ("utf8", "<nmaprun/>", "nmap", "refused", "port scans hold no findings"),
    ("utf8", "{\"server_scan_results\":[{\"server_info\":{}}]}", "sslyze", "refused", "sslyze before release 5"), ("utf8", "{\"site\":[],\"@version\":\"2\"}", "zap", "ok", None), ("utf8", "<results><result/></results>", "openvas", "ok", None), ("utf8", "<report><other/></report>", None, "unrecognised", None),
]
SAID = ", ".join("(" + ", ".join("NULL" if v is None else str(v) if isinstance(v, int) else f"'{v}'" for v in (i, scanner, status, reason, text if status != "encoding error" else None)) + ")" for i, (_, text, scanner, status, reason) in enumerate(FORMS))


def exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file an event, of each form by turns."""
    n = F.col("event_id")
    i = n % len(FORMS)
    form, text = pick(n, *[f[0] for f in FORMS]), pick(n, *[f[1] for f in FORMS])
    raw = lambda digits: F.unhex(F.lit(digits))
    content = (
        F.when(form == "bom", F.concat(raw("EFBBBF"), F.encode(text, "UTF-8"))).when(form == "blank", F.encode(join(" \r\n\t", text), "UTF-8")).when(form == "utf16le", F.concat(raw("FFFE"), F.encode(text, "UTF-16LE"))).when(form == "utf16be", F.concat(raw("FEFF"), F.encode(text, "UTF-16BE")))
        .when(form == "odd", raw("FFFE3C")).when(form == "lone", raw("FEFF003CD8000041")).otherwise(F.encode(text, "UTF-8"))
    )
    return read(spark, sf_dir, "events").select(n.cast("string").alias("path"), content.alias("content"), i.alias("form"))


@query(f"SELECT CAST(event_id AS VARCHAR) AS path, v.scanner, v.status, v.reason, v.text FROM events JOIN (VALUES {SAID}) AS v(i, scanner, status, reason, text) ON event_id % {len(FORMS)} = v.i")
def src1_src4_ing10_route(spark, sf_dir):
    return scans.route_files(exports(spark, sf_dir).drop("form"))


#: Broken and sound files of every scanner: text, scanner, status, reason. The last two items are found at a depth of their own.
BROKEN = [
    ("<NessusClientData_v2><Report><ReportHost name=\"h\"><ReportItem pluginID=\"1\"", "nessus", "parse error", "malformed XML"), ("<NessusClientData_v2></NessusClientData_v2>", "nessus", "ok", None), ("<issues burpVersion=\"1\"><issue><name>a & b</name></issue></issues>", "burp", "parse error", "malformed XML"),
    ("<issues burpVersion=\"1\"><issue><name>a</name></issue></issues>", "burp", "ok", None), ("<OWASPZAPReport><site></OWASPZAPReport>", "zap", "parse error", "malformed XML"), ("{\"@version\":\"2\",\"site\":[{\"alerts\":[{\"name\":\"x\"", "zap", "parse error", "malformed JSON"),
    ("{\"@version\":\"2\",\"site\":[{\"alerts\":[{\"name\":\"x\"}]}]}", "zap", "ok", None), ("<report id=\"1\"><results><result>", "openvas", "parse error", "malformed XML"), ("<SCAN><IP value=\"1\"></SCAN>", "qualys", "parse error", "malformed XML"),
    ("<SCAN></SCAN>trailing", "qualys", "parse error", "text after the root element"), ("<WAS_SCAN_REPORT><RESULTS><A></A></RESULTS>", "qualys", "parse error", "malformed XML"), ("<ASSET_DATA_REPORT/><!-- end -->", "qualys", "ok", None),
    ("{\"server_scan_results\":[{\"scan_status\":\"COMPLETED\"", "sslyze", "parse error", "malformed JSON"), ("{\"server_scan_results\":[]}", "sslyze", "ok", None), ("<ScanGroup><Scan><StartURL>u</StartURL>", "acunetix", "parse error", "malformed XML"),
    ("<ScanGroup><A><Scan><StartURL>u</StartURL><B><C><ReportItem><VulnID>v</VulnID><Name>deep</Name></ReportItem></C></B></Scan></A></ScanGroup>", "acunetix", "ok", None),
    ("<NessusClientData_v2><A><Report><B><ReportHost name=\"h\"><ReportItem pluginID=\"p\" pluginName=\"deep\"><description><![CDATA[<ReportHost name=\"no\">]]></description></ReportItem></ReportHost></B></Report></A></NessusClientData_v2>", "nessus", "ok", None),
]


def broken_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file an event, of each of ``BROKEN`` by turns."""
    n = F.col("event_id")
    return read(spark, sf_dir, "events").select(n.cast("string").alias("path"), F.encode(pick(n, *[f[0] for f in BROKEN]), "UTF-8").alias("content"))


TOLD = ", ".join("(" + ", ".join("NULL" if v is None else str(v) if isinstance(v, int) else f"'{v}'" for v in (i, scanner, status, reason)) + ")" for i, (_, scanner, status, reason) in enumerate(BROKEN))


@query(f"SELECT CAST(event_id AS VARCHAR) AS path, v.scanner, v.status, v.reason FROM events JOIN (VALUES {TOLD}) AS v(i, scanner, status, reason) ON event_id % {len(BROKEN)} = v.i")
def src4_parse_errors(spark, sf_dir):
    return scans.route_files(broken_exports(spark, sf_dir)).select("path", "scanner", "status", "reason")


@query(f"SELECT v.scanner, v.status, count(*) AS n_files FROM events JOIN (VALUES {TOLD}) AS v(i, scanner, status, reason) ON event_id % {len(BROKEN)} = v.i GROUP BY ALL")
def src4_file_status(spark, sf_dir):
    return scans.file_status(scans.route_files(broken_exports(spark, sf_dir)))


def _found(number: int, scanner: str, title: str, component: str, description: str = "") -> str:
    return f"SELECT CAST(event_id AS VARCHAR) AS scan_id, '{scanner}' AS scanner, '{title}' AS title, '{component}' AS component, '{description}' AS description FROM events WHERE event_id % {len(BROKEN)} = {number}"


@query(" UNION ALL ".join([_found(3, "burp", "a", ""), _found(6, "zap", "x", ""), _found(15, "acunetix", "deep", "u"), _found(16, "nessus", "deep", "h:/tcp", '<ReportHost name="no">')]))
def ing_any_depth(spark, sf_dir):
    """What the sound ones of ``BROKEN`` hold, wherever it stands; broken files give nothing and stop nothing."""
    routed = scans.store_routed(scans.route_files(broken_exports(spark, sf_dir)), scratch_folder(spark, "routed"))
    return scans.ingest(routed).select("scan_id", "scanner", "title", "component", "description")


@query(twin(
    key="'p' || k % 5", sev_rank="CAST(k % 5 AS INTEGER)", component="'h' || n || ':' || k || '/tcp'", title="'Check ' || k % 5", description="'D <' || k",
).replace(f"CAST(n // {A_FILE} AS VARCHAR) AS scan_id", "'all' AS scan_id"))
def src1_split_exports(spark, sf_dir):
    """Exports read in splits: all events as hosts of one report, in files that Spark wrote, each read by many tasks."""
    n, k = numbers()
    item = tag("ReportItem", join(tag("risk_factor", pick(k, "None", "Low", "Medium", "High", "Critical")), tag("description", join("<![CDATA[D <", k, "]]>"))), join(' pluginID="p', k % 5, '" pluginName="Check  ', k % 5, '" port="', k, '"'))
    host = read(spark, sf_dir, "events").orderBy("event_id").select(tag("ReportHost", item, join(' name="h', n, '"')).alias("value"))
    folder = scratch_folder(spark, "exports")
    host.write.text(folder)
    found = scans.split_exports(spark, folder, "ReportHost")
    # the files are the parts of one export: their names are in its order
    raw = scans.nessus_occurrences(found).withColumns({"pos": F.struct("scan_id", "pos"), "scan_id": F.lit("all")})
    return told(raw)


@query(twin(
    where="k % 6 <> 4", key="'b' || k % 4", sev_rank="[3, 2, 1, 0, 4, 0][k % 6 + 1]", confidence="[2, 1, 0][n % 3 + 1]", scale="['tentative', 'firm', 'certain']", component="'http://h/p' || k", title="'Issue ' || k % 4",
    description="CASE WHEN k % 2 = 0 THEN 'B <' || k || chr(10) || chr(10) ELSE '' END || 'D' || k", mitigation="'R'",
).replace(f"CAST(n // {A_FILE} AS VARCHAR) AS scan_id", "'all' AS scan_id"))
def src1_split_issues(spark, sf_dir):
    """All events as issues of one report, read in splits: names inside an issue that begin like it stay inside it."""
    n, k = numbers()
    issue = tag("issue", join(
        tag("type", join("b", k % 4)), tag("name", join("Issue  ", k % 4)), tag("host", "http://h"), tag("path", join("/p", k)), tag("severity", pick(k, "High", "Medium", "Low", "Information", "False positive", "odd")), tag("confidence", pick(n, "Certain", "Firm", "Tentative")),
        only(k % 2 == 0, tag("issueBackground", join("<![CDATA[B <", k, "]]>"))), tag("issueDetail", join("D", k)), tag("remediationBackground", "R"),
    ))
    folder = scratch_folder(spark, "exports")
    read(spark, sf_dir, "events").orderBy("event_id").select(issue.alias("value")).write.text(folder)
    raw = scans.burp_occurrences(scans.split_exports(spark, folder, "issue"))
    return told(raw.withColumns({"pos": F.struct("scan_id", "pos"), "scan_id": F.lit("all")}))
