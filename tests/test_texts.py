"""Rules over texts against sequential machines, and exports of any size and shape."""

import random
import re

import pytest
from pyspark.sql import functions as F

from findlake.functions import scoring, text
from findlake.operators import documents, lookups, rules
from findlake.sources import scans


def fence_machine(lines):
    """In-code flags line by line: the state is the open fence's mark and length."""
    out, state = [], None
    for line in lines:
        m = re.match(r"^ {0,3}(`{3,}|~{3,})(.*)$", line)
        if state is None:
            if m and not (m[1][0] == "`" and "`" in m[2]):
                state = (m[1][0], len(m[1]))
                out.append(True)
            else:
                out.append(False)
        else:
            out.append(True)
            if m and m[1][0] == state[0] and len(m[1]) >= state[1] and not m[2].strip(" \t"):
                state = None
    return out


def test_code_lines_are_those_of_the_machine(spark):
    rng = random.Random(2)
    pool = ["```", "````", "~~~", "~~~~~", " ```", "   ~~~~", "    ```", "```py", "``` a`b", "~~~ x", "text", "", "``` ", "~~~\t", "a ```", "``", "````` "]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 14))) + rng.choice(["", "\n", "\n\n"]) for _ in range(400)]
    texts += ["a\r\n```\u2028b\x0b```\r\nc", "", None, "\n", "```\n\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {(i, k + 1): f for i, t in enumerate(texts) if t for k, f in enumerate(fence_machine(t.splitlines()))}
    rows = documents.explode_lines(docs, fences=True).collect()
    assert {(r.doc_id, r.line): r.in_code for r in rows} == want
    assert {(r.doc_id, r.line): r.content for r in rows} == {(r.doc_id, r.line): r.content for r in documents.explode_lines(docs).collect()}
    # bare lines are put together again
    assert {(r.doc_id, r.line): r.in_code for r in documents.mark_fences(documents.explode_lines(docs)).collect()} == want


def raw_machine(s):
    pieces, raw, at = [], False, 0
    for m in re.finditer(r"(\{%-?\s*raw\s*-?%\})|(\{%-?\s*endraw\s*-?%\})", s):
        pieces.append((raw, s[at : m.start()]))
        raw = True if m[1] else False
        at = m.end()
    pieces.append((raw, s[at:]))
    return pieces


def test_raw_spans_are_those_of_the_machine(spark):
    rng = random.Random(3)
    pool = ["{% raw %}", "{%raw%}", "{%- raw -%}", "{% endraw %}", "{%-endraw\n-%}", "a", "b\n", "{{ x }}", "{% rawx %}"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(0, 10))) for _ in range(300)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in sorted(documents.raw_spans(docs).collect(), key=lambda r: (r.doc_id, r.ord)):
        got.setdefault(r.doc_id, []).append((r.literal, r.piece))
        assert r.closed is None or r.literal

    def joined(pieces):
        out = []
        for raw, p in pieces:
            if p and out and out[-1][0] == raw:
                out[-1] = (raw, out[-1][1] + p)
            elif p:
                out.append((raw, p))
        return out

    assert {i: joined(p) for i, p in got.items()} == {i: joined(raw_machine(t)) for i, t in enumerate(texts) if t and joined(raw_machine(t))}


def test_references_of_every_form(spark):
    md = "\n".join([
        "# H ![h](evidence/h.png)", "![alone](evidence/a.png)", "two ![x](evidence/b%20c.png 'T') and [**bold** `code`](d.md \"t\")", "", "- ![in list](e.png)", "", "  [cont](f.md)", "", "after [g](g.md)", "", "```", "![no](no.png)", "```", "`[no](no.md)` [[n] m](h.md)",
        "[full][Ref  A] [ref a][] [Ref A] [lost][none] [lost]", "[![img](i.png)](j.md)", "<https://k/l>", "> ![q](m.png)", "[ref a]: <n.md> \"D\"", "[ref A]: other.md", "[p](q(r).md) \\[s](t.md)", "[bad](u v)",
    ])
    docs = spark.createDataFrame([(1, md), (2, None), (3, "")], "doc_id long, text string")
    rows = documents.reference_lines(docs)
    got = [(r.line, r.kind[0], r.caption, r.ref_path, r.title, r.standalone, r.in_list_item) for r in sorted(documents.references(rows).collect(), key=lambda r: (r.line, r.ord))]
    assert got == [
        (1, "e", "h", "evidence/h.png", "", False, False), (2, "e", "alone", "evidence/a.png", "", True, False), (3, "e", "x", "evidence/b c.png", "T", False, False), (3, "c", "bold code", "d.md", "t", False, False), (5, "e", "in list", "e.png", "", False, True),
        (7, "c", "cont", "f.md", "", False, True), (9, "c", "g", "g.md", "", False, False), (14, "c", "[n] m", "h.md", "", False, False), (15, "c", "full", "n.md", "D", False, False), (15, "c", "ref a", "n.md", "D", False, False), (15, "c", "Ref A", "n.md", "D", False, False),
        (16, "c", "img", "j.md", "", False, False), (16, "e", "img", "i.png", "", False, False), (17, "c", "https://k/l", "https://k/l", "", False, False), (18, "e", "q", "m.png", "", False, False), (21, "c", "p", "q(r).md", "", False, False), (21, "c", "s", "t.md", "", False, False),
    ]
    assert [tuple(r) for r in documents.unparsed_references(rows).collect()] == [(1, 1)]


def test_sections_are_cut_inside_code_too(spark):
    docs = spark.createDataFrame([(1, "# T\n```\n## A \nx\n```\n## B\n"), (2, "## A\n\n"), (3, ""), (4, "stray\n# T\nmore\n# U\n## A\nz"), (5, "\n#  \n"), (6, "## A\n# T")], "doc_id long, text string")
    got = {(r.doc_id, r.section, r.start_line, r.n_lines, r.content) for r in documents.sections(docs).collect()}
    assert got == {(1, None, None, 2, "# T\n```"), (1, "A", 3, 2, "x\n```"), (1, "B", 6, 0, ""), (2, "A", 1, 1, ""), (4, None, None, 4, "stray\n# T\nmore\n# U"), (4, "A", 5, 1, "z"), (5, None, None, 2, "\n#  "), (6, "A", 1, 1, "# T")}
    told = {(r.doc_id, r.rule_id, r.line, r.message.split()[0]) for r in rules.title_rules(docs).collect()}
    assert told == {(1, "FND-016", 2, "text"), (2, "FND-013", None, "missing"), (3, "FND-013", None, "missing"), (4, "FND-013", 1, "missing"), (4, "FND-016", 3, "text"), (4, "FND-016", 4, "text"), (5, "FND-013", 2, "blank"), (6, "FND-013", None, "missing")}


def test_kinds_places_and_names(spark):
    paths = {  # kind, known place, badly named segments
        "methodology/library/.shelves/a.yml": ("shelf", True, []), "methodology/library/b/c": ("chapter", False, []), "methodology/library/b/c/.chapter.yml": (None, True, []), "methodology/library/b/images/f.md": ("image", True, []), "methodology/checklists/e/c/p.md": (None, True, []),
        "findings/reports/x.md": ("report", False, []), "findings/reports/r/.report.yml": (None, True, []), "findings/reports/r/evidence/a/b.png": (None, True, []), "findings/reports/R/evidence/My Shot.PNG": ("evidence", True, ["R"]), "findings/reports/r/notes/a.txt": (None, False, []),
        "findings/A b/C d.md": (None, False, ["A b", "C d.md"]), "other/A b": (None, False, []),
    }
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    got = {r.path: (r.kind, r.known) for r in df.select("path", text.expected_kind(F.col("path")).alias("kind"), text.known_place(F.col("path")).alias("known")).collect()}
    assert got == {p: (k, w) for p, (k, w, _) in paths.items()}
    assert sorted((r.path, r.message) for r in rules.segment_rule(df).collect()) == sorted((p, b) for p, (_, _, bad) in paths.items() for b in bad)
    assert {r.path for r in rules.place_rules(df).collect()} == {p for p, (_, w, _) in paths.items() if not w and p.split("/")[0] != "other"}


def test_internal_links_ask_for_kind_and_whole_path(spark):
    known = spark.createDataFrame([("b", "page", "p"), ("b", "chapter", "c")], "book string, kind string, slug string")
    urls = ["/books/b/page/P", "/books/b/chapter/p", "/books/b/page/c", "/books/B/page/p", "x/books/b/page/zz", "/books/b/page/zz/extra", "https://w/books/b/page/zz#f", "https://other/books/b/page/zz", "/books/b/page/p?x", "ftp://w/books/b/page/zz", "/books/b/chapter/c/"]
    links = spark.createDataFrame([(1, u) for u in urls], "doc_id int, url string")
    broken = {"/books/b/chapter/p", "/books/b/page/c", "/books/B/page/p", "https://w/books/b/page/zz#f", "/books/b/page/p?x"}
    assert {r.url for r in lookups.internal_link_check(links, known, "w").collect()} == broken
    assert {r.url for r in lookups.internal_link_check(links, known, None).collect()} == broken - {"https://w/books/b/page/zz#f"}


def test_entities_of_every_kind_are_decoded_once(spark):
    df = spark.createDataFrame([(1, "<p>&eacute;&#233;&#xE9; &amp;lt; &hellip;&nbsp;x</p><td>a</td> <td>b</td><!-- &lt; --><li> c "), (2, None), (3, "")], "id int, html string")
    assert {r.id: r.t for r in df.select("id", text.html_to_text(F.col("html")).alias("t")).collect()} == {1: "ééé &lt; …\u00a0xa | b\nc", 2: None, 3: ""}


def test_long_numbers_of_weaknesses(spark):
    df = spark.createDataFrame([(t,) for t in ("CWE-079", "cwe-12345678901", "0", "-1", "x", None)], "t string")
    assert [r.w for r in df.select(scoring.cwe_label(F.col("t")).alias("w")).collect()] == ["CWE-79", "CWE-12345678901", "", "", "", ""]


def test_losses_of_pages(spark):
    html = "<p class=x>a<br/><!-- <b> --><a href='u>v' onclick=\"x\">t</a><script src=1>if(a<b>c)</script><SPAN Style='a'><custom-tag>"
    df = spark.createDataFrame([(1, html), (2, "none"), (3, None)], "id int, html string")
    assert [tuple(r) for r in documents.html_losses(df, "id", "html").collect()] == [(1, 6, 2, "custom-tag,script", 2, "a@onclick,p@class")]


def write(folder, files):
    for name, data in files.items():
        (folder / name).write_bytes(data.encode() if isinstance(data, str) else data)


def test_no_file_vanishes(spark, tmp_path):
    host = '<ReportHost name="h"><ReportItem pluginID="1" pluginName="A"><description><![CDATA[<ReportHost name="x">]]></description></ReportItem></ReportHost>'
    files = {
        "cut.xml": f"<NessusClientData_v2><Report>{host}<ReportHost", "tags.xml": "<issues burpVersion='1'><issue></issues>", "tail.xml": "<SCAN></SCAN> x", "note.xml": "<SCAN></SCAN><!-- x --> \n<?y z?>\n", "cut.json": '{"server_scan_results":[{"a":1', "zap.json": '{"@version":"1","site":[{"alerts":[}]}', "ok.xml": f"<NessusClientData_v2><A><B>{host}</B></A></NessusClientData_v2>",
        "deep.xml": "<ScanGroup><X><Scan><StartURL>u</StartURL><Y><Z><ReportItem><VulnID>1</VulnID><AffectedItem>/a</AffectedItem></ReportItem><ReportItem><VulnID>2</VulnID></ReportItem></Z></Y></Scan></X></ScanGroup>", "odd.txt": "hello", "bad.bin": b"\xff\xfe<",
    }
    write(tmp_path, files)
    listed = scans.scan_files(spark, str(tmp_path))
    routed = scans.store_routed(scans.route_files(listed), str(tmp_path / "routed"))
    name = lambda r: r.path.rsplit("/", 1)[1]
    got = {name(r): (r.status, r.reason) for r in routed.collect()}
    assert got == {
        "cut.xml": ("parse error", "malformed XML"), "tags.xml": ("parse error", "malformed XML"), "tail.xml": ("parse error", "text after the root element"), "note.xml": ("ok", None), "cut.json": ("parse error", "malformed JSON"), "zap.json": ("parse error", "malformed JSON"), "ok.xml": ("ok", None), "deep.xml": ("ok", None),
        "odd.txt": ("unrecognised", None), "bad.bin": ("encoding error", "not UTF-16LE"),
    }
    assert scans.file_status(routed).agg(F.sum("n_files")).first()[0] == len(files)
    found = sorted((r.scan_id.rsplit("/", 1)[1], r.pos, r.key, r.component, r.description) for r in scans.ingest(routed).collect())
    assert found == [("deep.xml", 0, "1", "u/a", ""), ("deep.xml", 1, "2", "u", ""), ("ok.xml", 0, "1", "h:/tcp", '<ReportHost name="x">')]
    lost = scans.unread_files(listed, listed.where(~F.col("path").endswith("ok.xml")))
    assert [(name(r), r.status) for r in lost.collect()] == [("ok.xml", "read error")]


def test_an_export_is_read_by_many_tasks(spark, tmp_path):
    hosts = "".join(f'<ReportHost name="h{i}"><ReportItem pluginID="{i % 7}" port="1"><description>{"d" * (i % 50)} &lt;b&gt;</description></ReportItem></ReportHost>\n' for i in range(3000)) + '<ReportHost name="last"/>'
    write(tmp_path, {"big.xml": f"<NessusClientData_v2><Policy/><Report>{hosts}</Report></NessusClientData_v2>"})
    files = scans.scan_files(spark, str(tmp_path / "big.xml")).select("path", F.col("content").cast("string").alias("text"))
    columns = ["pos", "key", "component", "description"]
    whole = sorted(map(tuple, scans.nessus_occurrences(files).select(*columns).collect()))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        found = scans.split_exports(spark, str(tmp_path / "big.xml"), "ReportHost")
        tasks = spark.read.option("lineSep", "<ReportHost").text(str(tmp_path / "big.xml")).rdd.getNumPartitions()
        assert tasks > 4 and sorted(map(tuple, scans.nessus_occurrences(found).select(*columns).collect())) == whole and len(whole) == 3000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


SPLIT_TEXTS = {
    "issue": (scans.burp_occurrences, "<issues burpVersion='1'>{}</issues>", "<issue><type>{i}</type><name>n</name><host ip='1.1.1.1'>h</host><path>/p</path><issueBackground>b{i}</issueBackground><issueDetail><![CDATA[<issue >]]></issueDetail><remediationDetail>r</remediationDetail></issue >"),
    "alertitem": (scans.zap_occurrences, "<OWASPZAPReport><site><alerts>{}</alerts></site></OWASPZAPReport>", "<alertitem><pluginid>{i}</pluginid><alertitems>x</alertitems><alert>a</alert><desc>d{i}</desc><instances><instance><uri>u{i}</uri></instance></instances></alertitem>"),
    "Scan": (scans.acunetix_occurrences, "<ScanGroup>{}</ScanGroup>", "<Scan><StartURL>u</StartURL><Scanner>s</Scanner><ReportItems><ReportItem><VulnID>{i}</VulnID><AffectedItem>/{i}</AffectedItem></ReportItem></ReportItems></Scan>"),
    "IP": (scans.qualys_scan_occurrences, "<SCAN>{}</SCAN>", "<IP value='{i}'><IPS/><VULNS><CAT><VULN number='q' severity='3'><TITLE>t{i}</TITLE></VULN></CAT></VULNS></IP>"),
    "ReportHost": (scans.nessus_occurrences, "<NessusClientData_v2>{}</NessusClientData_v2>", "<ReportHost name='e{i}'/><!-- <ReportHost name='c'> --><ReportHost name='h{i}'><ReportItem pluginID='1'/></ReportHost>"),
}


@pytest.mark.parametrize("tag", SPLIT_TEXTS)
def test_split_exports_give_what_whole_files_give(spark, tmp_path, tag):
    parser, whole, one = SPLIT_TEXTS[tag]
    write(tmp_path, {"a.xml": whole.format("\n".join(one.replace("{i}", str(i)) for i in range(400))), "none.xml": whole.format("")})
    files = scans.scan_files(spark, str(tmp_path)).select("path", F.col("content").cast("string").alias("text"))
    ordered = lambda raw: [tuple(r)[1:] for r in raw.select("pos", "key", "title", "component", "description", "mitigation").orderBy("pos").collect()]
    want = ordered(parser(files))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        assert ordered(parser(scans.split_exports(spark, str(tmp_path), tag))) == want and len(want) == 400
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_asset_reports_are_read_in_splits(spark, tmp_path):
    host = "<HOST><IP>{i}</IP><HOSTNAME>x</HOSTNAME><VULN_INFO_LIST><VULN_INFO><QID>1</QID></VULN_INFO></VULN_INFO_LIST></HOST>"
    detail = "<GLOSSARY><VULN_DETAILS_LIST><VULN_DETAILS id='1'><QID>1</QID><TITLE>T</TITLE><THREAT>t</THREAT></VULN_DETAILS></VULN_DETAILS_LIST></GLOSSARY>"
    write(tmp_path, {"a.xml": "<ASSET_DATA_REPORT><HOST_LIST>" + "".join(host.replace("{i}", f"10.0.0.{i}") for i in range(50)) + f"</HOST_LIST>{detail}</ASSET_DATA_REPORT>"})
    path = str(tmp_path / "a.xml")
    found = scans.qualys_vm_occurrences(*[scans.split_exports(spark, path, tag) for tag in ("HOST", "VULN_DETAILS")])
    assert [(r.title, r.component, r.description) for r in found.orderBy("pos").collect()] == [("T", f"10.0.0.{i}", "t") for i in range(50)]


def test_one_container_of_results_is_read(spark):
    result = lambda oid: f"<result><nvt oid='{oid}'/></result>"
    report = lambda *parts: f"<report>{''.join(parts)}</report>"
    results = lambda *oids: f"<results>{''.join(map(result, oids))}</results>"
    response = "<get_reports_response>{}</get_reports_response>"
    forms = {
        "first of two": (response.format(report(report(results("1", "2"))) + report(report(results("3")))), ["1", "2"]), "behind an empty one": (response.format(report(report(results())) + report(report(results("3")))), []),
        "outer after empty inner": (response.format(report(results("4"), report(results()))), ["4"]), "inner before outer": (response.format(report(results("5"), report(results("6")))), ["6"]), "bare": (report(results("7")), ["7"]),
        "reports without results": (response.format(report("<a/>") + report(report("<a/>"), report(results("8")))), ["8"]), "none": (report("<a/>"), []), "inner of a report": (report(report(results("9")), results("10")), ["9"]),
    }
    files = spark.createDataFrame([(name, text) for name, (text, _) in forms.items()], "path string, text string")
    got = {name: [] for name in forms}
    for r in scans.openvas_occurrences(files).orderBy("pos").collect():
        got[r.scan_id].append(r.key)
    assert got == {name: oids for name, (_, oids) in forms.items()}
