"""Own operators on small tables."""

import json
import random

import pytest
from pyspark.sql import functions as F

from findlake.functions import scoring, text
from findlake.operators import documents, lookups, occurrences, reconcile
from findlake.sources import scans
from findlake.streaming import findings


def one(spark, column, value=None):
    return spark.createDataFrame([(value,)], "v string").select(column.alias("x")).first()[0]


def test_merge_keeps_first_values_and_order_whatever_the_partitioning(spark):
    rows = [("s", "k", i, "c%d" % (7 - i % 5) if i % 3 else "", i % 4, None if i == 0 else f"t{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "scan_id string, key string, pos long, component string, sev_rank int, title string")
    got = [occurrences.merge_occurrences(df.repartition(n), first=["title"]).collect() for n in (1, 7)]
    assert got[0] == got[1]
    row = got[0][0]
    seen = list(dict.fromkeys(r[3] for r in rows if r[3]))
    assert (row.sev_rank, row.components, row.title, row.first_pos, row.n_occurrences) == (3, seen, None, 0, 40)


def test_merge_of_nothing_is_nothing(spark):
    df = spark.createDataFrame([], "scan_id string, key string, pos long, component string, sev_rank int")
    assert occurrences.merge_occurrences(df).count() == 0


def test_severity_filter_words():
    assert scoring.parse_severity_filter("critical-medium") == ["medium", "high", "critical"]
    assert scoring.parse_severity_filter("moderate, info") == ["informational", "medium"]
    with pytest.raises(ValueError):
        scoring.parse_severity_filter("worst")


@pytest.mark.parametrize(("vector", "score"), [("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H", 9.8), ("CVSS:3.0/AV:N/AC:L/PR:L/UI:R/S:C/C:L/I:L/A:N", 5.4), ("CVSS:3.1/AV:L/AC:L/PR:N/UI:R/S:U/C:N/I:N/A:N", 0.0), ("CVSS:3.1/AV:N", None)])
def test_cvss_score(spark, vector, score):
    assert one(spark, scoring.cvss_base_score(F.lit(vector))) == score


def test_slug_folds_letters(spark):
    assert one(spark, text.slugify(F.lit("  Straße Ærø – Ünïcode!  "))) == "strasse-aero-unicode"
    assert one(spark, text.slugify(F.lit("***"))) == "untitled"


def test_lines_are_those_of_python(spark):
    for s in ("a\nb\r\nc\x85d e", "a\n", "", "\n\n", "x\x1cy"):
        assert one(spark, text.lines(F.col("v")), s) == s.splitlines()


@pytest.mark.parametrize(("indexed", "l", "r", "b", "mode", "outcome"), [
    (True, "a", "a", None, "read-write", "CLEAN"), (True, "a", "a", "o", "read-write", "REPAIR"), (True, "a", "o", "o", "read-write", "PUSH"), (True, "o", "a", "o", "read-write", "PULL"),
    (True, "a", "b", "o", "read-write", "COLLISION"), (True, "a", "b", None, "read-write", "COLLISION"), (True, "o", None, "o", "read-write", "DELETE_LOCAL"), (True, "a", None, "o", "read-write", "COLLISION"),
    (True, None, "o", "o", "read-write", "DELETE_REMOTE"), (True, None, None, "o", "read-write", "FORGET"), (False, "a", None, None, "read-write", "CREATE"), (False, None, "a", None, "read-write", "PULL_NEW"),
    (True, "a", "o", "o", "read-only", "INVALID"), (True, "o", "a", "o", "read-only", "PULL"), (False, None, "a", None, "append-only", "CLEAN"),
])
def test_classify(spark, indexed, l, r, b, mode, outcome):  # noqa: E741
    df = spark.createDataFrame([(indexed, l, r, b, mode)], "indexed boolean, local_hash string, remote_hash string, base_hash string, mode string")
    assert reconcile.classify(df).first().outcome == outcome


def test_guard_is_strict(spark):
    plan = lambda n: spark.createDataFrame([("k", "PUSH", False)] * n + [("k", "CLEAN", False)] * 4, "kind string, outcome string, forced boolean")
    assert reconcile.change_guard(plan(5)).where("outcome = 'WITHHELD'").count() == 0
    assert reconcile.change_guard(plan(6)).where("outcome = 'WITHHELD'").count() == 6


def test_second_run_after_apply_is_clean(spark):
    rows = [(f"p{i}", "k", i, "read-write", True, "n" if i % 3 == 0 else "o", "m" if i % 3 == 1 else "o", "o") for i in range(30)] + [("new", "k", None, "read-write", False, "x", None, None)]
    schema = "path string, kind string, id long, mode string, indexed boolean, local_hash string, remote_hash string, base_hash string"
    after = reconcile.apply_plan(reconcile.classify(spark.createDataFrame(rows, schema)))
    assert {r.outcome for r in reconcile.classify(after).collect()} == {"CLEAN"}
    assert after.where("path = 'new'").first().id == 30


def test_greedy_match_is_the_sequential_one(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    rng = random.Random(3)
    edges = [(f"o{i}", f"n{j}", rng.choice([0.6, 0.7, 0.8, 1.0])) for i in range(6) for j in range(6) if rng.random() < 0.6]
    want, a, b = [], set(), set()
    for o, n, s in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        if o not in a and n not in b:
            want.append((o, n, s))
            a.add(o)
            b.add(n)
    got = lookups.greedy_match(spark.createDataFrame(edges, "old_path string, new_path string, score double"))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_names_that_look_numbered(spark):
    rows = [(1, "f", "a"), (2, "f", "a-2"), (3, "f", "a"), (4, "f", "a"), (5, "g", "a"), (6, "g", "a")]
    got = lookups.dedupe_names_exact(spark.createDataFrame(rows, "id int, folder string, name string"))
    assert {r.id: r.unique_name for r in got.collect()} == {1: "a", 2: "a-2", 3: "a-3", 4: "a-4", 5: "a", 6: "a-2"}


def test_rules_have_a_failing_and_a_passing_row(spark):
    docs = spark.createDataFrame([(1, "ok\n"), (2, "bad \r\nend"), (3, "")], "doc_id long, text string")
    assert {(r.rule_id, r.doc_id, r.line) for r in documents.line_hygiene(docs).collect()} == {("WIKI-009", 2, None), ("WIKI-010", 2, 1), ("WIKI-011", 2, None)}


NESSUS = """<?xml version="1.0"?><NessusClientData_v2><Report><ReportHost name="h1"><ReportItem pluginID="7" pluginName="Weak" svc_name="www" port="80" protocol="tcp"><risk_factor>High</risk_factor>
<synopsis>S</synopsis><description>D</description><solution>Fix</solution><see_also>http://a
http://b</see_also><cwe>79</cwe><cvss_vector>CVSS2#AV:N/AC:M/Au:N/C:P/I:N/A:N</cvss_vector></ReportItem></ReportHost></Report></NessusClientData_v2>"""
BURP = """<issues burpVersion="1"><issue><type>9</type><name>X</name><host ip="1.2.3.4">http://h</host><path>/p</path><location>/p [q]</location><severity>Medium</severity><confidence>Firm</confidence><issueBackground>B</issueBackground></issue></issues>"""


def test_files_are_routed_and_parsed(spark, tmp_path):
    for name, data in {"a.xml": NESSUS.encode(), "b.xml": BURP.encode("utf-16"), "c.xml": b"<nmaprun/>", "d.txt": b"hello", "e.xml": b"\xff\xfe<"}.items():
        (tmp_path / name).write_bytes(data)
    routed = scans.route_files(scans.scan_files(spark, str(tmp_path)))
    assert {r.path[-5:]: (r.scanner, r.status) for r in routed.collect()} == {"a.xml": ("nessus", "ok"), "b.xml": ("burp", "ok"), "c.xml": ("nmap", "refused"), "d.txt": (None, "unrecognised"), "e.xml": (None, "encoding error")}
    rows = {r.scanner: r for r in scans.ingest(routed).collect()}
    n, b = rows["nessus"], rows["burp"]
    assert (n.key, n.sev_rank, n.component, n.cwe, n.description, len(n.references)) == ("7", 3, "h1:80/tcp (www)", "CWE-79", "S\n\nD", 2)
    assert n.cvss_vector == "CVSS:3.1/AV:N/AC:H/PR:N/UI:N/S:U/C:L/I:N/A:N"
    assert (b.key, b.sev_rank, b.component) == ("9", 2, "http://h/p [q] (1.2.3.4)")


ZAP_ALERT = {"alertRef": "40", "name": "Z", "riskcode": 2, "desc": "D", "reference": "http://a\nhttp://b", "cweid": "79", "instances": [{"uri": "u1"}, {"uri": ""}, {"uri": "u2"}]}
ZAP_XML = "<OWASPZAPReport><site><alerts><alertitem><pluginid>5</pluginid><alert>Q</alert><riskdesc>High (Low)</riskdesc></alertitem></alerts></site></OWASPZAPReport>"
ACUNETIX = """<ScanGroup><Scan><StartURL>http://s</StartURL><ReportItems><ReportItem><Name>A</Name><VulnID>v1</VulnID><Severity>3</Severity><AffectedItem>/x</AffectedItem><CWEList><CWE id="89">CWE-89</CWE></CWEList>
<Tags><Tag>CVE-1-2</Tag><Tag>sql</Tag></Tags><References><Reference>http://r</Reference></References><CVSS4><Descriptor>CVSS:4.0/X</Descriptor></CVSS4></ReportItem><ReportItem><Name>B</Name><Severity>low</Severity><CWE>79</CWE></ReportItem></ReportItems></Scan></ScanGroup>"""
Q_SCAN = """<SCAN><IP value="10.0.0.1"><VULNS><CAT><VULN number="11" severity="5"><TITLE>T</TITLE><CVE_ID_LIST><CVE_ID><ID>CVE-1</ID><URL>http://c</URL></CVE_ID></CVE_ID_LIST></VULN></CAT></VULNS></IP></SCAN>"""
Q_WAS = """<WAS_SCAN_REPORT><GLOSSARY><QID_LIST><QID><QID>7</QID><TITLE>W</TITLE><SEVERITY>4</SEVERITY><CVSS_V3><VECTOR_STRING>AV:N</VECTOR_STRING></CVSS_V3></QID><QID><QID>8</QID><SEVERITY>5</SEVERITY><GROUP>DIAG</GROUP></QID></QID_LIST></GLOSSARY>
<RESULTS><WEB_APPLICATION><VULNERABILITY_LIST><VULNERABILITY><QID>7</QID><URL>http://w</URL></VULNERABILITY><VULNERABILITY><QID>9</QID></VULNERABILITY></VULNERABILITY_LIST><INFORMATION_GATHERED_LIST><INFORMATION_GATHERED><QID>8</QID></INFORMATION_GATHERED></INFORMATION_GATHERED_LIST></WEB_APPLICATION></RESULTS></WAS_SCAN_REPORT>"""
Q_VM = """<ASSET_DATA_REPORT><HOST_LIST><HOST><IP>1.1.1.1</IP><DNS>d</DNS><VULN_INFO_LIST><VULN_INFO><QID>3</QID><PORT>443</PORT></VULN_INFO></VULN_INFO_LIST></HOST></HOST_LIST><GLOSSARY><VULN_DETAILS_LIST><VULN_DETAILS><QID>3</QID><TITLE>M</TITLE><SEVERITY>2</SEVERITY>
<CVSS3_SCORE><CVSS3_BASE>9.0 (AV:N/AC:H)</CVSS3_BASE></CVSS3_SCORE></VULN_DETAILS></VULN_DETAILS_LIST></GLOSSARY></ASSET_DATA_REPORT>"""
TLS = {"server_scan_results": [
    {"scan_status": "COMPLETED", "server_location": {"hostname": "h", "port": 8443}, "scan_result": {
        "ssl_2_0_cipher_suites": {"status": "COMPLETED", "result": {"accepted_cipher_suites": [{"a": 1}]}}, "tls_1_0_cipher_suites": {"status": "ERROR", "result": {"accepted_cipher_suites": [{}]}},
        "robot": {"status": "COMPLETED", "result": {"robot_attack_enum": "VULNERABLE_WEAK"}}, "certificate_info": {"status": "COMPLETED", "result": {"certificate_deployments": [
            {"leaf_certificate_is_within_validity_period": False, "path_validation_results": [{"verified_certificate_chain": None}], "received_chain": [{"public_key": {"algorithm": "RSA", "key_size": 1024}}]}]}}}},
    {"scan_status": "ERROR", "server_location": {"hostname": "down"}, "scan_result": None},
]}


def test_the_other_exports_are_parsed(spark, tmp_path):
    files = {
        "z.json": json.dumps({"@version": "2", "site": {"alerts": [ZAP_ALERT]}}), "z.xml": ZAP_XML, "a.xml": ACUNETIX, "q1.xml": Q_SCAN, "q2.xml": Q_WAS, "q3.xml": Q_VM, "t.json": json.dumps(TLS),
        "old.json": json.dumps({"server_scan_results": [{"server_info": {}, "scan_commands_results": {}}]}),
    }
    for name, data in files.items():
        (tmp_path / name).write_text(data)
    routed = scans.route_files(scans.scan_files(spark, str(tmp_path))).cache()
    assert {r.path.rsplit("/", 1)[1] for r in routed.where("status <> 'ok'").collect()} == {"old.json"}
    got = {}
    for r in scans.ingest(routed).orderBy("scan_id", "pos").collect():
        got.setdefault(r.scan_id.rsplit("/", 1)[1], []).append(r)
    brief = {name: [(r.key, r.title, r.sev_rank, r.component) for r in rows] for name, rows in got.items()}
    assert brief == {
        "z.json": [("40", "Z", 2, "u1"), ("40", "Z", 2, "u2")], "z.xml": [("5", "Q", 3, "")], "a.xml": [("v1", "A", 3, "http://s/x"), ("B", "B", 1, "http://s")], "q1.xml": [("11", "T", 4, "10.0.0.1")],
        "q2.xml": [("7", "W", 3, "http://w"), ("9", "QID 9", 2, ""), ("8", "QID 8", 0, "")], "q3.xml": [("3", "M", 1, "d:443")],
        "t.json": [("sslyze:ssl_2_0", "SSL 2.0 Enabled", 4, "h:8443"), ("sslyze:robot", "ROBOT Attack", 3, "h:8443"), ("sslyze:cert_expired", "Expired TLS Certificate", 3, "h:8443"),
                   ("sslyze:cert_untrusted", "Untrusted or Self-Signed TLS Certificate", 2, "h:8443"), ("sslyze:cert_weak_key", "Weak TLS Certificate Public Key", 2, "h:8443")],
    }
    assert ([x.text for x in got["a.xml"][0].references], got["a.xml"][0].cwe, got["a.xml"][1].cwe) == (["CVE-1-2", "http://r"], "CWE-89", "CWE-79")
    assert (got["q1.xml"][0].references[0].url, got["q2.xml"][0].cvss_vector, got["q3.xml"][0].cvss_vector) == ("http://c", "CVSS:3.0/AV:N", "CVSS:3.0/AV:N/AC:H")
    assert [x.text for x in got["z.json"][0].references] == ["http://a", "http://b"]


def test_reference_texts_and_captions(spark):
    docs = spark.createDataFrame([(1, "r", " ![old](evidence/a.png) \nx [t](../evidence/b.png) ![in](evidence/a.png)\n"), (2, "r", "plain "), (3, "r", None), (4, "r", ""), (5, "other", "![k](evidence/a.png)")], "doc_id int, folder string, text string")
    files = spark.createDataFrame([("r", "a.png", 7, "New", "why")], "folder string, filename string, id int, caption string, description string")
    got = {r.doc_id: r.prose for r in reconcile.prose_with_ids(docs, files).collect()}
    assert got == {1: "![](7) \nx [unresolved](unresolved) ![](7)", 2: "plain", 3: None, 4: "", 5: "![](unresolved)"}
    got = {r.doc_id: r.text for r in reconcile.rewrite_captions(docs, files).collect()}
    assert got == {1: ' ![New](evidence/a.png "why") \nx [t](../evidence/b.png) ![in](evidence/a.png)\n', 2: "plain ", 3: None, 4: "", 5: "![k](evidence/a.png)"}
    state = reconcile.prose_with_ids(docs, files).select("doc_id", F.sha2("prose", 256).alias("base_hash"))
    again = reconcile.ripple_push(docs, files.withColumn("id", F.lit(8)), state)
    assert {r.doc_id for r in again.where("outcome = 'PUSH'").collect()} == {1}


def test_file_sets_fail_on_long_captions(spark):
    rows = [("a", "x" * 256, "n", "o", "o", False), ("b", None, "n", "o", "o", False), ("c", None, "o", "o", "o", True)]
    slots = spark.createDataFrame(rows, "path string, local_caption string, local_body string, remote_body string, base string, conflict boolean").selectExpr(
        "path", "'f' AS kind", "'read-write' AS mode", "true AS indexed", "local_caption", "CAST(NULL AS STRING) AS remote_caption", "local_body", "remote_body", "sha2(concat(base, '\n'), 256) AS base_hash", "conflict"
    )
    assert {r.path: r.outcome for r in reconcile.file_set_plan(slots).collect()} == {"a": "FAILED", "b": "MOVE_EDIT", "c": "FAILED"}


def test_project_without_rows_is_its_heading(spark):
    none = "project_id int, pos int, "
    tables = [spark.createDataFrame([], none + c) for c in ("name string, entries string, disallowed boolean, caution boolean", "objective string, status string, priority string, deadline string, complete boolean", "hostname string, ip string, compromised boolean", "title string, issued string")]
    projects = spark.createDataFrame([(1, "Code", "Client"), (2, None, None)], "project_id int, codename string, client string")
    got = {r.project_id: r.context for r in lookups.project_context(projects, *tables).collect()}
    assert got == {1: "# Code\n\n**Client:** Client\n", 2: "# Project\n"}


def test_frontmatter_of_nulls_lacks_its_fields(spark):
    docs = spark.createDataFrame([(1, None, None, None, None)], "doc_id int, tier string, fields map<string,string>, cwe array<int>, tags array<string>")
    known = spark.createDataFrame([(79,)], "cwe_id int")
    assert sorted((r.rule_id, r.message) for r in documents.frontmatter_rules(docs, known).collect()) == [("FND-002", "finding_type"), ("FND-002", "severity")]


def test_scope_filter_takes_every_scope(spark):
    known = spark.range(10_050).select(F.concat(F.lit("/p"), F.col("id"), F.lit("/x.md")).alias("path"))
    failures = known.select(F.lit("R").alias("rule_id"), "path").unionByName(spark.createDataFrame([("R", "/p1x/x.md"), ("R", None)], "rule_id string, path string"))
    scopes = spark.range(10_050).select(F.concat(F.lit("/p"), F.col("id")).alias("path"))
    found = documents.scope_filter(failures, scopes, known)
    assert found.columns == failures.columns and found.count() == 10_050
    assert documents.scope_filter(failures.unionByName(failures), scopes.where("path = '/p7'").unionByName(known.where("path = '/p7/x.md'")), known).count() == 2
    with pytest.raises(ValueError):
        documents.scope_filter(failures, scopes.unionByName(spark.createDataFrame([("/none",)], "path string")), known)


@pytest.mark.parametrize(
    ("vector", "score"),
    [("CVSS:3.0/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H", 9.8), ("CVSS:3.0/AV:N/AC:L/PR:N/UI:N/S:U/C:L/I:L/A:L", 7.3), ("CVSS:3.0/AV:L/AC:L/PR:L/UI:N/S:U/C:H/I:N/A:N", 5.4), ("CVSS:3.1/AV:L/AC:L/PR:L/UI:N/S:U/C:H/I:N/A:N", 5.5)],
)
def test_scores_of_three_zero_go_to_the_nearest_tenth(spark, vector, score):
    assert spark.createDataFrame([(vector,)], "v string").select(scoring.cvss_base_score(F.col("v"))).first()[0] == score


def test_every_later_segment_of_a_vector_is_checked(spark):
    good = "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H"
    rows = [(good + "/E:X/MC:H",), (good + "/E:Q",), (good + "/" + "/".join(f"X{i}:N" for i in range(1500)),)]
    got = [r[0] for r in spark.createDataFrame(rows, "v string").select(scoring.cvss_parse(F.col("v"))["error"]).collect()]
    assert got == [None, "illegal value", "unknown metric"]


def test_wrapped_and_bare_reports_give_their_results(spark):
    from findlake.sources import scans

    result = "<result><host>h</host><port>80/tcp</port><severity>9.8</severity><nvt oid='1'><name>n</name><tags>summary=s|cvss_base_vector=AV:N/AC:L/Au:N/C:C/I:C/A:C</tags><refs><ref type='cve' id='CVE-1'/><ref type='x' id='no'/></refs></nvt></result>"
    forms = {"a": f"<get_reports_response><report id='1'><report><results>{result}</results></report></report></get_reports_response>", "b": f"<report id='1'><report><results>{result}</results></report></report>", "c": f"<report id='1'><results>{result}</results></report>"}
    files = spark.createDataFrame(list(forms.items()), "path string, text string")
    got = scans.openvas_occurrences(files).collect()
    assert sorted(r.scan_id for r in got) == ["a", "b", "c"]
    assert all((r.component, r.description, r.cvss_vector, [x.text for x in r.references]) == ("h:80/tcp", "s", "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H", ["CVE-1"]) for r in got)


def test_line_rules(spark):
    from findlake.operators import documents

    docs = spark.createDataFrame([(1, "a\r\nb\r\n"), (2, "a \nb\n"), (3, "a\rb\n"), (4, ""), (5, "a​⁡\n")], "doc_id long, text string")
    got = sorted((r.rule_id, r.doc_id, r.line) for r in documents.line_hygiene(docs).collect())
    assert got == [("WIKI-009", 1, None), ("WIKI-009", 3, None), ("WIKI-010", 2, 1)]
    assert [(r.doc_id, r.message) for r in documents.control_characters(documents.explode_lines(docs)).collect()] == [(5, "U+200B")]


def test_numbers_in_groups_of_any_size(spark):
    from findlake.operators.numbering import numbered

    rows = [("hot", i * 37 % 1000) for i in range(1000)] + [("a", None), ("a", 1), (None, 5), (None, 4)]
    df = spark.createDataFrame(rows, "g string, v int").repartition(7)
    got = {(r.g, r.v): r.k for r in numbered(df, ["g"], ["v"], "k").collect()}
    assert got == {**{("hot", v): v + 1 for v in range(1000)}, ("a", None): 1, ("a", 1): 2, (None, 4): 1, (None, 5): 2}
    assert numbered(df.where("v > 5000"), ["g"], ["v"], "k").count() == 0


def test_families_of_names_are_numbered_apart(spark):
    rows = [(1, "d", "a-2"), (2, "d", "a"), (3, "d", "a"), (4, "d", "a"), (5, "d", "b"), (6, "d", "b"), (7, "e", "a"), (8, "d", "a-2"), (9, None, "a")]
    got = lookups.dedupe_names_exact(spark.createDataFrame(rows, "id int, folder string, name string"))
    assert {r.id: r.unique_name for r in got.collect()} == {1: "a-2", 2: "a", 3: "a-3", 4: "a-4", 5: "b", 6: "b-2", 7: "a", 8: "a-2-2", 9: "a"}


def test_findings_keep_the_first_and_the_surest(spark, tmp_path):
    issue = lambda name, severity, sure, path: f"<issue><type>1</type><name>{name}</name><host ip='1.1.1.1'></host><path>{path}</path><severity>{severity}</severity><confidence>{sure}</confidence></issue>"
    burp = "<issues burpVersion='1'>" + issue("A  b", "Low", "Tentative", "/x") + issue("other", "High", "Certain", "/y") + issue("other", "Low", "Firm", "/x") + "</issues>"
    nessus = NESSUS.replace("CVSS2#AV:N/AC:M/Au:N/C:P/I:N/A:N", "junk").replace('svc_name="www"', 'svc_name=""').replace('protocol="tcp"', "")
    for name, text in {"b.xml": burp, "n.xml": nessus}.items():
        (tmp_path / name).write_text(text)
    routed = scans.store_routed(scans.route_files(scans.scan_files(spark, str(tmp_path))), str(tmp_path / "routed"))
    got = {r.scanner: r for r in scans.findings(scans.ingest(routed)).collect()}
    b, n = got["burp"], got["nessus"]
    assert (b.title, b.sev_rank, b.components, b.tags, b.notes) == ("A b", 3, ["1.1.1.1/x", "1.1.1.1/y"], ["confidence:certain"], [])
    assert (n.components, n.cvss_vector, n.notes, n.tags) == (["h1:80/tcp"], "", ["CVSS v2 vector junk could not be converted, dropped"], [])


def test_lone_surrogates_are_an_encoding_error(spark, tmp_path):
    for name, data in {"good": b"\xff\xfe" + "<nmaprun a='\U0001f600'/>".encode("utf-16-le"), "high": b"\xff\xfe<\x00\x3d\xd8", "low": b"\xfe\xff\x00<\xde\x00", "twice": b"\xfe\xff\xd8\x3d\xd8\x3d\xde\x00"}.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: r.status for r in scans.route_files(scans.scan_files(spark, str(tmp_path))).collect()}
    assert got == {"good": "refused", "high": "encoding error", "low": "encoding error", "twice": "encoding error"}


def test_similar_pairs_are_those_of_all_pairs(spark):
    import random
    from difflib import SequenceMatcher

    rng = random.Random(3)
    texts = ["", " ", "a", "aa  b"] + ["".join(rng.choice("ab ") for _ in range(rng.randrange(1, 60))) for _ in range(56)]
    rows = [("x" if i % 3 else "y", i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "block string, path int, text string")
    got = {(r.old_path, r.new_path): round(r.score, 9) for r in lookups.similar_pairs(df.where("path % 2 = 0"), df.where("path % 2 = 1")).collect()}
    want = {}
    for b, i, s in rows[::2]:
        for c, j, t in rows[1::2]:
            s2, t2 = " ".join(s.split()), " ".join(t.split())
            score = 1.0 if s2 == t2 else SequenceMatcher(None, t2, s2).ratio()
            if b == c and score >= 0.6:
                want[i, j] = round(score, 9)
    assert got == want


def test_images_are_translated_both_ways(spark):
    docs = spark.createDataFrame([(1, True, "![a](images/x.png \"t\") images/x.png ![b](../images/y.png)![](images/x.png)"), (2, False, None), (3, False, "")], "doc_id int, in_chapter boolean, text string")
    gallery = spark.createDataFrame([("x.png", "https://g/1")], "name string, url string")
    remote = lookups.translate_urls(docs, gallery)
    assert {r.doc_id: r.text for r in remote.collect()} == {1: "![a](https://g/1 \"t\") images/x.png ![b](../images/y.png)![](https://g/1)", 2: None, 3: ""}
    assert {r.doc_id: r.text for r in lookups.localise_urls(remote, gallery).collect()}[1] == "![a](../images/x.png \"t\") images/x.png ![b](../images/y.png)![](../images/x.png)"
