"""Scanner exports: reading, recognising and routing of files, and their parsing to raw occurrences."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from findlake.functions.scoring import cvss2_to_3, cwe_label, ensure_cvss3_prefix, score_to_severity, severity_from_rank, severity_name, severity_rank
from findlake.functions.text import collapse_whitespace, html_escape, refs_to_html
from findlake.operators.lookups import glossary_join
from findlake.operators.numbering import numbered
from findlake.operators.occurrences import merge_occurrences

DETECT_CHARS = 65536
#: Root elements that name a scanner.
ROOTS = {
    "NessusClientData_v2": "nessus", "nmaprun": "nmap", "OWASPZAPReport": "zap", "ScanGroup": "acunetix", "get_reports_response": "openvas", "WAS_SCAN_REPORT": "qualys",
    "SCAN": "qualys", "ASSET_DATA_REPORT": "qualys",
}
OCCURRENCE = ["scan_id", "scanner", "pos", "key", "title", "sev_rank", "component", "cvss_vector", "cwe", "description", "impact", "mitigation", "references", "confidence", "tags", "steps", "notes"]
#: The words for confidence of each scale from low to high.
CONFIDENCES = {"zap": ["false-positive", "low", "medium", "high"], "burp": ["tentative", "firm", "certain"]}
PEEKED_ELEMENTS = 200
#: The words of notes on vectors that are left out.
CVSS2_NOTE = ("CVSS v2 vector ", " could not be converted, dropped")
CVSS4_NOTE = "only a CVSS v4 vector was present, dropped (v4 not supported in workspace format 2)"


def scan_files(spark: SparkSession, *paths: str) -> DataFrame:
    """``path, length, content``: files, and the direct files of folders; a path that isn't there is an error at once."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(list(paths)).select("path", "length", "content")


def decode_text(files: DataFrame) -> DataFrame:
    """``text`` without byte order mark and leading white space, or ``decode_error`` (odd lengths and lone surrogates of UTF-16 included)."""
    head = F.hex(F.substring("content", 1, 3))
    rest = lambda n: F.expr(f"substring(content, {n + 1}, length(content))")
    charset = F.when(head.startswith("FFFE"), "UTF-16LE").when(head.startswith("FEFF"), "UTF-16BE").otherwise("UTF-8")
    body = F.when(head == "EFBBBF", rest(3)).when(charset != "UTF-8", rest(2)).otherwise(F.col("content"))
    plain = F.when(charset == "UTF-16LE", F.decode(body, "UTF-16LE")).when(charset == "UTF-16BE", F.decode(body, "UTF-16BE")).otherwise(body.cast("string"))
    units = F.regexp_replace(F.hex(body), "(....)", "$1 ")
    high, low = (F.when(charset == "UTF-16LE", f"..D[{digits}]").otherwise(f"D[{digits}]..") for digits in ("89AB", "C-F"))
    lone = F.concat(F.lit("(?:^| )"), high, F.lit(" (?!"), low, F.lit(")|(?:^| )(?<!"), high, F.lit(" )"), low)
    good = F.when(charset == "UTF-8", F.is_valid_utf8(plain)).when(F.length(body) % 2 != 0, False).otherwise(~F.regexp_like(units, lone))
    return files.withColumn("text", F.when(good, F.regexp_replace(plain, r"(?U)^\s+", ""))).withColumn("decode_error", F.when(~good, F.concat(F.lit("not "), charset)))


def detect_format(text: Column) -> Column:
    """The scanner of an export, from its first 65536 characters and, under a general root, its first 200 elements; null if none is recognised."""
    head = F.substring(text, 1, DETECT_CHARS)
    json = F.when(head.contains('"server_scan_results"'), "sslyze").when(head.contains('"site"') & (head.contains('"@version"') | head.contains('"@generated"')), "zap")
    body = F.regexp_replace(head, r"(?s)^(?:\s*<\?.*?\?>|\s*<!--.*?-->|\s*<!DOCTYPE[^>\[]*(?:\[.*?\])?\s*>)+", "")
    tag = F.regexp_extract(body, r"^\s*<(?:[\w.-]+:)?([\w.-]+)", 1)
    start = F.regexp_extract(body, r"^\s*<([^>]*)>", 1)
    near = F.slice(F.regexp_extract_all(body, F.lit(r"<(?:[\w.-]+:)?([A-Za-z_][\w.-]*)"), 1), 2, PEEKED_ELEMENTS)
    named = F.lit(None).cast("string")
    for root, scanner in ROOTS.items():
        named = F.when(tag == root, scanner).otherwise(named)
    generic = (
        F.when((tag == "issues") & start.contains("burpVersion"), "burp")
        .when(tag.isin("report", "results") & (start.rlike(r"\sid\s*=") | F.arrays_overlap(near, F.array(*map(F.lit, ("report_format", "results", "omp", "result"))))), "openvas")
    )
    return F.when(head.rlike(r"^\s*[\[{]"), json).otherwise(F.coalesce(named, generic))


def parse_problem(text: Column) -> Column:
    """Why an export can't be parsed, else null: JSON or XML that isn't well-formed, or text after the root element."""
    json = F.when(F.try_parse_json(text).isNull(), "malformed JSON")
    bad = F.from_xml(text, "_bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})["_bad"]
    after = F.regexp_replace(text, r"(?s)(?:\s++|<!--.*?-->|<\?.*?\?>)++\z", "")
    xml = F.when(bad.isNotNull(), "malformed XML").when(~after.endswith(">"), "text after the root element")
    return F.when(text.rlike(r"^\s*[\[{]"), json).otherwise(xml)


def unread_files(listed: DataFrame, files: DataFrame) -> DataFrame:
    """Status rows of the listed files whose content couldn't be read (a reader that leaves such files out)."""
    none = F.lit(None).cast("string")
    return listed.select("path").distinct().join(files.select("path"), "path", "left_anti").select("path", none.alias("scanner"), F.lit("read error").alias("status"), none.alias("reason"), none.alias("text"))


def route_files(files: DataFrame) -> DataFrame:
    """``path, scanner, status, reason, text``: every file gets one status, and a bad one doesn't stop the others.

    Statuses: ok, unrecognised, encoding error, refused, parse error. A file of a known scanner that isn't well-formed has the last
    one, so that no input disappears; an export that is sound and empty is ok.
    """
    told = decode_text(files).withColumn("scanner", detect_format(F.col("text")))
    refusal = F.when(F.col("scanner") == "nmap", "port scans hold no findings").when((F.col("scanner") == "sslyze") & predates_v5(F.col("text")), "sslyze before release 5")
    told = told.withColumn("__refusal", refusal)
    told = told.withColumn("__problem", F.when(F.col("scanner").isNotNull() & F.col("__refusal").isNull(), parse_problem(F.col("text"))))
    status = (
        F.when(F.col("decode_error").isNotNull(), "encoding error").when(F.col("scanner").isNull(), "unrecognised").when(F.col("__refusal").isNotNull(), "refused")
        .when(F.col("__problem").isNotNull(), "parse error").otherwise("ok")
    )
    return told.select("path", "scanner", status.alias("status"), F.coalesce("decode_error", "__refusal", "__problem").alias("reason"), "text")


def file_status(routed: DataFrame) -> DataFrame:
    """``scanner, status, n_files``: together as many as there are files."""
    return routed.groupBy("scanner", "status").agg(F.count("*").alias("n_files"))


def plain_markup(text: Column) -> Column:
    """XML without comments and processing instructions, character data sections spelled out with entities."""
    special = r"(?s)<!\[CDATA\[(.*?)\]\]>|<!--.*?-->|<\?.*?\?>"
    inner = F.regexp_extract_all(text, F.lit(special), F.lit(1))
    spelled = lambda c: F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    joined = F.array_join(F.zip_with(F.split(text, special, -1), inner, lambda gap, c: F.concat(gap, spelled(c))), "")
    return F.when(text.rlike(r"<!\[CDATA\[|<!--|<\?"), joined).otherwise(text)


def _closed(tag: str, rest: Column) -> Column:
    """The element whose start tag ``rest`` goes on from; what follows the element is cut off."""
    head = F.regexp_extract(rest, r"""^(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""", 0)
    whole = F.when(head.endswith("/>"), head).otherwise(F.concat(F.get(F.split(rest, rf"</{tag}\s*>", 2), F.lit(0)), F.lit(f"</{tag}>")))
    return F.concat(F.lit(f"<{tag}"), whole)


def elements(rows: DataFrame, tag: str, xml: str, *keep: str) -> DataFrame:
    """``pos, element`` and the columns ``keep``: every element of that name in the column ``xml``, wherever it stands, numbered from 0 in order.

    Elements of one name must not hold each other. Each is a row of its own, so that an export is parsed element by element.
    """
    return rows.select(*keep, F.posexplode(_starts(plain_markup(F.col(xml)), tag)).alias("pos", "__rest")).select(*keep, "pos", _closed(tag, F.col("__rest")).alias("element"))


def _starts(text: Column, tag: str) -> Column:
    """What follows each start of an element of that name in plain markup."""
    return F.slice(F.split(text, rf"<{tag}(?=[\s>/])", -1), 2, 2**30)


def split_exports(spark: SparkSession, paths: str | list[str], tag: str) -> DataFrame:
    """``scan_id, pos, element``: the elements of UTF-8 exports of any size, a file in as many tasks as it has splits.

    Files are read as records that end with ``</tag>``, so no task holds a file; ``pos`` follows the places in the file. Names that
    begin alike (``issueDetail`` inside ``issue``) and empty elements are told apart within a record. The end tag must be written
    without blanks where elements are to be records of their own, and must not occur inside comments or character data.
    """
    records = spark.read.option("lineSep", f"</{tag}>").text(paths).select(F.col("_metadata.file_path").alias("scan_id"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__id"), "value")
    found = records.select("scan_id", "__block", "__id", F.posexplode(_starts(plain_markup(F.col("value")), tag)).alias("__at", "__rest"))
    placed = numbered(found, ["scan_id"], ["__block", "__id", "__at"], "pos")
    return placed.select("scan_id", (F.col("pos") - 1).alias("pos"), _closed(tag, F.col("__rest")).alias("element"))


def _elements(files: DataFrame, tag: str) -> DataFrame:
    return files if "element" in files.columns else elements(files.select(F.col("path").alias("scan_id"), "text"), tag, "text", "scan_id")


def _read(element: str, fields: str) -> Column:
    return F.from_xml(element, f"struct<{fields}>", {"mode": "PERMISSIVE"})


def _parse(files: DataFrame, root: str, schema: str) -> DataFrame:
    parsed = F.from_xml("text", schema, {"rowTag": root, "mode": "PERMISSIVE"})
    return files.select(F.col("path").alias("scan_id"), parsed.alias("x"))


def _text(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit("")))


def _joined(*columns: Column) -> Column:
    """Non-blank texts with a blank line between."""
    return F.array_join(F.filter(F.array(*columns), lambda x: x != ""), "\n\n")


def _refs(urls: Column) -> Column:
    return F.transform(F.filter(urls, lambda u: F.trim(u) != ""), lambda u: F.struct(F.trim(u).alias("text"), F.lit(None).cast("string").alias("url")))


def _none() -> Column:
    return F.array().cast("array<string>")


def _unconverted(vector: Column, converted: Column) -> Column:
    """The note on a vector of CVSS 2 that can't be read as one."""
    return F.when((vector != "") & converted.isNull(), F.array(F.concat(F.lit(CVSS2_NOTE[0]), vector, F.lit(CVSS2_NOTE[1])))).otherwise(_none())


def _more(confidence: Column | None = None, tags: Column | None = None, steps: Column | None = None, notes: Column | None = None) -> list[Column]:
    """The last columns of an occurrence; a null confidence, empty lists and an empty text stand for none."""
    told = F.lit(None).cast("string") if confidence is None else confidence
    lists = [_none() if c is None else c for c in (tags, notes)]
    return [told.alias("confidence"), lists[0].alias("tags"), (F.lit("") if steps is None else steps).alias("steps"), lists[1].alias("notes")]


def nessus_occurrences(files: DataFrame, drop_snoozed: bool = False) -> DataFrame:
    """Items of every host. ``files`` is (path, text), or ``ReportHost`` elements of ``split_exports``."""
    item = "struct<_pluginID:string,_pluginName:string,_svc_name:string,_port:string,_protocol:string,risk_factor:string,synopsis:string,description:string,solution:string,see_also:string,cwe:string,cvss3_vector:string,cvss_vector:string,snoozed:string>"
    hosts = _elements(files, "ReportHost").select("scan_id", F.col("pos").alias("h"), _read("element", f"_name:string,ReportItem:array<{item}>").alias("host"))
    items = hosts.select("scan_id", "h", F.col("host._name").alias("name"), F.posexplode("host.ReportItem").alias("i", "r"))
    if drop_snoozed:
        items = items.where(_text("r.snoozed") == "")
    service = F.when(_or_empty("r._svc_name") != "", F.concat(F.lit(" ("), F.col("r._svc_name"), F.lit(")"))).otherwise("")
    where = F.concat(_or_empty("name"), F.lit(":"), _or_empty("r._port"), F.lit("/"), F.coalesce("r._protocol", F.lit("tcp")), service)
    old, converted = _text("r.cvss_vector"), cvss2_to_3(F.col("r.cvss_vector"))
    vector = F.when(_text("r.cvss3_vector") != "", ensure_cvss3_prefix(F.col("r.cvss3_vector"))).when(old != "", F.coalesce(converted, F.lit(""))).otherwise("")
    notes = F.when(_text("r.cvss3_vector") == "", _unconverted(old, converted)).otherwise(_none())
    key = _or_empty("r._pluginID")
    return items.select(
        "scan_id", F.lit("nessus").alias("scanner"), (F.col("h").cast("long") * (1 << 32) + F.col("i")).alias("pos"), key.alias("key"), F.coalesce("r._pluginName", F.concat(F.lit("Plugin "), key)).alias("title"),
        severity_rank(severity_name(F.col("r.risk_factor"))).alias("sev_rank"), where.alias("component"), vector.alias("cvss_vector"), cwe_label(F.col("r.cwe")).alias("cwe"),
        _joined(_text("r.synopsis"), _text("r.description")).alias("description"), F.lit("").alias("impact"), _text("r.solution").alias("mitigation"), _refs(F.split(F.coalesce("r.see_also", F.lit("")), "\r\n|\r|\n")).alias("references"), *_more(notes=notes),
    )


def burp_occurrences(files: DataFrame) -> DataFrame:
    """Issues but false positives. ``files`` is (path, text), or ``issue`` elements of ``split_exports``."""
    issue = "type:string,name:string,host:struct<_VALUE:string,_ip:string>,path:string,location:string,severity:string,confidence:string,issueBackground:string,issueDetail:string,remediationBackground:string,remediationDetail:string,references:string"
    rows = _elements(files, "issue").select("scan_id", "pos", _read("element", issue).alias("r"))
    kept = rows.where(F.lower(_text("r.severity")) != "false positive")
    ip = _text("r.host._ip")
    host = F.when(_text("r.host._VALUE") != "", _text("r.host._VALUE")).otherwise(ip)
    where = F.trim(F.concat(host, F.when(_text("r.location") != "", _text("r.location")).otherwise(_text("r.path")), F.when((ip != "") & (ip != host), F.concat(F.lit(" ("), ip, F.lit(")"))).otherwise("")))
    anchor = r"""(?is)<a\s+href=['"]([^'"]+)['"][^>]*>(.*?)</a>"""
    hrefs, labels = (F.regexp_extract_all(_or_empty("r.references"), F.lit(anchor), i) for i in (1, 2))
    refs = F.zip_with(labels, hrefs, lambda text, url: F.struct(text.alias("text"), url.alias("url")))
    said = F.lower(_text("r.confidence"))
    return kept.select(
        "scan_id", F.lit("burp").alias("scanner"), F.col("pos").cast("long").alias("pos"), _text("r.type").alias("key"), F.coalesce("r.name", F.lit("Unknown")).alias("title"), severity_rank(severity_name(F.col("r.severity"))).alias("sev_rank"),
        where.alias("component"), F.lit("").alias("cvss_vector"), F.lit("").alias("cwe"), _joined(_text("r.issueBackground"), _text("r.issueDetail")).alias("description"), F.lit("").alias("impact"),
        _joined(_text("r.remediationBackground"), _text("r.remediationDetail")).alias("mitigation"), refs.alias("references"), *_more(F.when(said.isin(*CONFIDENCES["burp"]), said)),
    )


ALERT = "pluginid:string,alertRef:string,id:string,alert:string,name:string,riskcode:string,riskdesc:string,desc:string,description:string,solution:string,reference:string,references:string,cweid:string,confidence:string"
INSTANCE = "struct<uri:string,method:string,param:string>"
#: Fixed value: so many instances of an alert are listed in its steps; every one of them gives its component.
SHOWN_INSTANCES = 20


def zap_occurrences(files: DataFrame) -> DataFrame:
    """XML and JSON reports: an occurrence an instance with a uri, or one without component where there is none.

    A JSON report holds one site, a list of sites, or is itself the list. ``files`` is (path, text), or ``alertitem`` elements of
    ``split_exports``.
    """
    if "element" in files.columns:
        return _zap_alerts([_zap_items(files)])
    is_json = F.coalesce(F.col("text").rlike(r"^\s*[\[{]"), F.lit(False))
    sites = F.when(F.col("text").rlike(r"^\s*\["), F.col("text")).otherwise(F.get_json_object("text", "$.site"))
    told = F.from_json(sites, f"array<struct<alerts:array<struct<{ALERT},instances:array<{INSTANCE}>>>>>")
    from_json = files.where(is_json).select(F.col("path").alias("scan_id"), F.posexplode(told).alias("s", "site")).select("scan_id", "s", F.posexplode("site.alerts").alias("a", "r"))
    from_json = from_json.select("scan_id", "s", F.col("a").cast("long").alias("a"), F.col("r").dropFields("instances").alias("r"), F.col("r.instances").alias("all"))
    return _zap_alerts([from_json, _zap_items(files.where(~is_json))])


def _zap_items(files: DataFrame) -> DataFrame:
    parsed = _elements(files, "alertitem").select("scan_id", F.lit(0).alias("s"), F.col("pos").cast("long").alias("a"), _read("element", f"{ALERT},instances:struct<instance:array<{INSTANCE}>>").alias("r"))
    return parsed.select("scan_id", "s", "a", F.col("r").dropFields("instances").alias("r"), F.col("r.instances.instance").alias("all"))


def _zap_alerts(alerts: list[DataFrame]) -> DataFrame:
    """Occurrences of alerts: scan_id, the places s and a of site and alert, the alert's fields r, its instances all."""
    wanted = lambda instances: F.filter(instances, lambda n: F.coalesce(n["uri"], F.lit("")) != "")
    each = reduce(DataFrame.unionByName, alerts).select("*", F.posexplode_outer(wanted(F.col("all"))).alias("i", "n"))
    empty = F.lit("")
    step = lambda n: F.concat(
        F.lit("<li>"), html_escape(F.coalesce(n["uri"], empty)), F.lit(" ["), html_escape(F.coalesce(n["method"], F.lit("GET"))), F.lit("]"),
        F.when(F.coalesce(n["param"], empty) != "", F.concat(F.lit(" param: <code>"), html_escape(n["param"]), F.lit("</code>"))).otherwise(""), F.lit("</li>"),
    )
    steps = F.when(F.size("all") > 0, F.concat(F.lit("<ul>"), F.array_join(F.transform(F.slice("all", 1, SHOWN_INSTANCES), step), ""), F.lit("</ul>"))).otherwise("")
    code = F.substring(_text("r.riskcode"), 1, 1)
    word = F.when(code.isin("0", "1", "2", "3"), F.element_at(F.array(*map(F.lit, ("informational", "low", "medium", "high"))), code.try_cast("int") + 1)).otherwise(severity_name(F.regexp_extract(_text("r.riskdesc"), r"^([^(]*)", 1)))
    filled = lambda *names: F.coalesce(*[F.when(_text(f"r.{n}") != "", F.col(f"r.{n}")) for n in names], F.lit(""))
    key = filled("alertRef", "pluginid", "id")
    refs = F.split(F.regexp_replace(F.coalesce("r.reference", "r.references", F.lit("")), "\r", ""), "\n")
    level = _text("r.confidence")
    sure = F.when(level.isin(*"0123"), F.element_at(F.array(*map(F.lit, CONFIDENCES["zap"])), level.try_cast("int") + 1))
    return each.select(
        "scan_id", F.lit("zap").alias("scanner"), (F.col("s").cast("long") * (1 << 50) + F.col("a").cast("long") * (1 << 25) + F.coalesce("i", F.lit(0))).alias("pos"), key.alias("key"),
        F.coalesce("r.name", "r.alert", F.concat(F.lit("Alert "), key)).alias("title"), severity_rank(word).alias("sev_rank"), _text("n.uri").alias("component"), F.lit("").alias("cvss_vector"),
        cwe_label(F.col("r.cweid")).alias("cwe"), F.coalesce("r.desc", "r.description", F.lit("")).alias("description"), F.lit("").alias("impact"), _text("r.solution").alias("mitigation"), _refs(refs).alias("references"), *_more(sure, steps=steps),
    )


def openvas_occurrences(files: DataFrame, min_qod: int = 0) -> DataFrame:
    """Results of one container; results below ``min_qod`` or without an oid are left out.

    Three paths are tried: reports inside reports, then any report (the outer before its inner ones), then the root. Of each path
    only the first container is looked at, and the first of these three with results is taken; further reports of a response, and
    one behind an empty container, are not read.
    """
    result = "struct<severity:string,host:struct<_VALUE:string,hostname:string>,port:string,qod:struct<value:string>,description:string,nvt:struct<_oid:string,name:string,tags:string,refs:struct<ref:array<struct<_id:string,_type:string>>>>>"
    results = f"results:struct<result:array<{result}>>"
    wide = f"report array<struct<report:array<struct<{results}>>,{results}>>, {results.replace(':', ' ', 1)}"
    rows = _parse(files, "report", wide)
    reports = F.coalesce(F.col("x.report"), F.array())
    inner = lambda r: F.coalesce(F.transform(r["report"], lambda q: q["results"]), F.array())
    there = lambda containers: F.filter(containers, lambda c: c.isNotNull())
    paths = [there(F.flatten(F.transform(reports, inner))), there(F.flatten(F.transform(reports, lambda r: F.concat(F.array(r["results"]), inner(r)))))]
    paths.append(F.concat(there(F.array("x.results")), paths[1]))
    first = F.coalesce(*[F.when(F.size(F.get(p, F.lit(0))["result"]) > 0, F.get(p, F.lit(0))["result"]) for p in paths])
    items = rows.select("scan_id", F.posexplode(first).alias("pos", "r")).where((_text("r.nvt._oid") != "") & (F.coalesce(F.col("r.qod.value").try_cast("int"), F.lit(0)) >= min_qod))
    pairs = F.split(_or_empty("r.nvt.tags"), r"\|")
    # the last of equal names counts
    tag = lambda name: F.coalesce(F.trim(F.regexp_replace(F.try_element_at(F.filter(pairs, lambda p: p.rlike(rf"^\s*{name}\s*=")), F.lit(-1)), r"^[^=]*=", "")), F.lit(""))
    old, converted = tag("cvss_base_vector"), cvss2_to_3(tag("cvss_base_vector"))
    vector = F.when(old.startswith("CVSS:"), old).otherwise(F.coalesce(converted, F.lit("")))
    notes = F.when(old.startswith("CVSS:"), _none()).otherwise(_unconverted(old, converted))
    where = F.concat(F.when(_text("r.host.hostname") != "", _text("r.host.hostname")).otherwise(_text("r.host._VALUE")), F.when(F.lower(_text("r.port")).isin("", "general/tcp"), "").otherwise(F.concat(F.lit(":"), _text("r.port"))))
    return items.select(
        "scan_id", F.lit("openvas").alias("scanner"), F.col("pos").cast("long").alias("pos"), F.col("r.nvt._oid").alias("key"), F.when(_text("r.nvt.name") != "", _text("r.nvt.name")).otherwise(F.col("r.nvt._oid")).alias("title"),
        severity_rank(score_to_severity(F.coalesce(F.col("r.severity").try_cast("double"), F.lit(0.0)))).alias("sev_rank"), where.alias("component"), vector.alias("cvss_vector"), F.lit("").alias("cwe"), F.when(tag("summary") != "", tag("summary")).otherwise(_text("r.description")).alias("description"), tag("impact").alias("impact"), tag("solution").alias("mitigation"),
        _refs(F.coalesce(F.transform(F.filter("r.nvt.refs.ref", lambda f: f["_type"].isin("cve", "url")), lambda f: f["_id"]), _none())).alias("references"), *_more(notes=notes),
    )


def acunetix_occurrences(files: DataFrame) -> DataFrame:
    """Report items of every scan, at any depth; CVE tags come before the references. An item whose only vector is of CVSS 4 gets a note.

    ``files`` is (path, text), or ``Scan`` elements of ``split_exports``.
    """
    item = (
        "struct<Name:string,VulnID:string,Severity:string,AffectedItem:string,Description:string,Impact:string,Recommendation:string,CWE:string,CWEList:struct<CWE:array<struct<_VALUE:string,_id:string>>>,"
        "Tags:struct<Tag:array<string>>,References:struct<Reference:array<struct<_VALUE:string>>>,CVSS3:struct<Descriptor:string>,CVSS4:struct<Descriptor:string>>"
    )
    scans = _elements(files, "Scan").select("scan_id", F.col("pos").alias("s"), _read("element", "StartURL:string").getField("StartURL").alias("url"), "element")
    found = elements(scans.withColumnRenamed("element", "__scan"), "ReportItem", "__scan", "scan_id", "s", "url").withColumnRenamed("pos", "i")
    items = found.select("scan_id", "s", "url", "i", _read("element", item[7:-1]).alias("r"))
    key = F.coalesce(*[F.when(_text(c) != "", _text(c)) for c in ("r.VulnID", "r.Name")], F.lit("unknown"))
    level = _text("r.Severity")
    word = F.when(level.isin(*"01234"), severity_from_rank(level.try_cast("int"))).otherwise(severity_name(level))
    listed = F.element_at("r.CWEList.CWE", 1)
    cwe = F.when(F.size("r.CWEList.CWE") > 0, F.coalesce(F.when(F.trim(listed["_id"]) != "", listed["_id"]), listed["_VALUE"])).otherwise(F.col("r.CWE"))
    tags = F.filter(F.transform(F.coalesce("r.Tags.Tag", _none()), lambda t: F.trim(t)), lambda t: t != "")
    cves = F.filter(tags, lambda t: F.upper(t).startswith("CVE-"))
    v4_only = (_text("r.CVSS4.Descriptor") != "") & (_text("r.CVSS3.Descriptor") == "")
    refs = F.concat(cves, F.transform(F.coalesce("r.References.Reference", F.array().cast("array<struct<_VALUE:string>>")), lambda x: F.coalesce(x["_VALUE"], F.lit(""))))
    return items.select(
        "scan_id", F.lit("acunetix").alias("scanner"), (F.col("s").cast("long") * (1 << 32) + F.col("i")).alias("pos"), key.alias("key"), F.coalesce(F.when(_text("r.Name") != "", _text("r.Name")), F.concat(F.lit("Finding "), key)).alias("title"),
        severity_rank(word).alias("sev_rank"), F.concat(_text("url"), _text("r.AffectedItem")).alias("component"), _text("r.CVSS3.Descriptor").alias("cvss_vector"), cwe_label(cwe).alias("cwe"),
        _text("r.Description").alias("description"), _text("r.Impact").alias("impact"), _text("r.Recommendation").alias("mitigation"), _refs(refs).alias("references"),
        *_more(tags=tags, notes=F.when(v4_only, F.array(F.lit(CVSS4_NOTE))).otherwise(_none())),
    )


ID_URL = "array<struct<ID:string,URL:string>>"


def _id_refs(*lists: str) -> Column:
    """References of id and, where there is one, URL."""
    every = F.concat(*[F.coalesce(F.col(c), F.array().cast(ID_URL)) for c in lists])
    return F.transform(F.filter(every, lambda x: F.coalesce(x["ID"], F.lit("")) != ""), lambda x: F.struct(x["ID"].alias("text"), F.when(x["URL"] != "", x["URL"]).alias("url")))


def _qualys(rows: DataFrame) -> DataFrame:
    """Occurrences of rows of scan_id, pos, key, severity (a code of 1 to 5, or a word), diagnostic, component and texts."""
    code = F.col("severity")
    word = F.when(F.col("diagnostic"), "informational").when(code.isin(*"12345"), severity_from_rank(code.try_cast("int") - 1)).otherwise(severity_name(code))
    title = F.coalesce(F.when(F.col("title") != "", F.col("title")), F.concat(F.lit("QID "), F.col("key")))
    return rows.select(
        "scan_id", F.lit("qualys").alias("scanner"), "pos", "key", title.alias("title"), severity_rank(word).alias("sev_rank"), "component", "cvss_vector", F.lit("").alias("cwe"), "description", "impact", "mitigation", "references", *_more(),
    )


def _qualys_defaults() -> dict[str, object]:
    """What stands in for an entry that the glossary lacks."""
    texts = dict.fromkeys(["title", "cvss_vector", "description", "impact", "mitigation"], "")
    return texts | {"severity": "3", "diagnostic": False, "references": F.array().cast("array<struct<text:string,url:string>>")}


def _or_empty(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def _severity_or_3(c: str) -> Column:
    return F.coalesce(F.when(F.col(c) != "", F.col(c)), F.lit("3"))


def qualys_scan_occurrences(files: DataFrame) -> DataFrame:
    """Vulnerability scans: everything stands at the address itself. ``files`` is (path, text), or ``IP`` elements of ``split_exports``."""
    vuln = f"struct<_number:string,_severity:string,TITLE:string,CONSEQUENCE:string,DIAGNOSIS:string,SOLUTION:string,CVE_ID_LIST:struct<CVE_ID:{ID_URL}>>"
    rows = _elements(files, "IP").select("scan_id", F.col("pos").alias("p"), _read("element", f"_value:string,_addr:string,VULNS:struct<CAT:array<struct<VULN:array<{vuln}>>>>").alias("ip"))
    each = rows.select("scan_id", "p", F.coalesce("ip._value", "ip._addr", F.lit("")).alias("component"), F.posexplode("ip.VULNS.CAT").alias("c", "cat"))
    each = each.select("scan_id", "p", "c", "component", F.posexplode("cat.VULN").alias("i", "r"))
    return _qualys(each.select(
        "scan_id", (F.col("p").cast("long") * (1 << 40) + F.col("c").cast("long") * (1 << 20) + F.col("i")).alias("pos"), _or_empty("r._number").alias("key"), _or_empty("r.TITLE").alias("title"), F.coalesce("r._severity", F.lit("3")).alias("severity"),
        F.lit(False).alias("diagnostic"), "component", F.lit("").alias("cvss_vector"), _or_empty("r.CONSEQUENCE").alias("description"), _or_empty("r.DIAGNOSIS").alias("impact"), _or_empty("r.SOLUTION").alias("mitigation"), _id_refs("r.CVE_ID_LIST.CVE_ID").alias("references"),
    ))


def qualys_was_occurrences(files: DataFrame) -> DataFrame:
    """Web application reports: vulnerabilities, then information gathered, with texts from the report's own glossary."""
    entry = f"struct<QID:string,TITLE:string,SEVERITY:string,`GROUP`:string,DESCRIPTION:string,IMPACT:string,SOLUTION:string,CVSS_V3:struct<VECTOR_STRING:string>,CVE_LIST:struct<CVE:{ID_URL}>>"
    rows = _elements(files, "GLOSSARY").select("scan_id", _read("element", f"QID_LIST:struct<QID:array<{entry}>>").alias("x"))
    results = elements(files.select(F.col("path").alias("scan_id"), "text"), "RESULTS", "text", "scan_id").withColumnRenamed("element", "__results").drop("pos")
    listed = [elements(results, tag, "__results", "scan_id").withColumn("__kind", F.lit(i)) for i, tag in enumerate(("VULNERABILITY", "INFORMATION_GATHERED"))]
    each = listed[0].unionByName(listed[1]).select("scan_id", (F.col("__kind").cast("long") * (1 << 40) + F.col("pos")).alias("pos"), _read("element", "QID:string,URL:string").alias("r"))
    found = each.select("scan_id", "pos", _or_empty("r.QID").alias("key"), _or_empty("r.URL").alias("component"))
    glossary = rows.select("scan_id", F.posexplode("x.QID_LIST.QID").alias("__at", "g")).where(_or_empty("g.QID") != "").select(
        "scan_id", "__at", F.col("g.QID").alias("key"), _or_empty("g.TITLE").alias("title"), _severity_or_3("g.SEVERITY").alias("severity"), (_or_empty("g.GROUP").startswith("IG-DIAG") | (_or_empty("g.GROUP") == "DIAG")).alias("diagnostic"),
        ensure_cvss3_prefix(F.col("g.CVSS_V3.VECTOR_STRING")).alias("cvss_vector"), _or_empty("g.DESCRIPTION").alias("description"), _or_empty("g.IMPACT").alias("impact"), _or_empty("g.SOLUTION").alias("mitigation"), _id_refs("g.CVE_LIST.CVE").alias("references"),
    )
    return _qualys(glossary_join(found, glossary, ["scan_id", "key"], "__at", _qualys_defaults()))


def qualys_vm_occurrences(files: DataFrame, details: DataFrame | None = None) -> DataFrame:
    """Asset reports: a host's entries at its name (else address) and port, with texts from the report's own glossary.

    ``files`` is (path, text), or ``HOST`` elements of ``split_exports``, with ``details`` the ``VULN_DETAILS`` elements of the same files.
    """
    detail = f"struct<QID:string,TITLE:string,SEVERITY:string,THREAT:string,IMPACT:string,SOLUTION:string,CVSS3_SCORE:struct<CVSS3_BASE:string>,CVE_ID_LIST:struct<CVE_ID:{ID_URL}>,VENDOR_REFERENCE_LIST:struct<VENDOR_REFERENCE:{ID_URL}>>"
    hosts = _elements(files, "HOST").select("scan_id", F.col("pos").alias("h"), _read("element", "IP:string,DNS:string,VULN_INFO_LIST:struct<VULN_INFO:array<struct<QID:string,PORT:string>>>").alias("host"))
    details = _elements(files if details is None else details, "VULN_DETAILS").select("scan_id", F.col("pos").alias("__at"), _read("element", detail[7:-1]).alias("g"))
    each = hosts.select("scan_id", "h", F.coalesce(F.when(F.col("host.DNS") != "", F.col("host.DNS")), F.col("host.IP"), F.lit("")).alias("label"), F.posexplode("host.VULN_INFO_LIST.VULN_INFO").alias("i", "r"))
    where = F.when((F.col("label") != "") & (_or_empty("r.PORT") != ""), F.concat_ws(":", "label", "r.PORT")).otherwise(F.col("label"))
    found = each.where(_or_empty("r.QID") != "").select("scan_id", (F.col("h").cast("long") * (1 << 32) + F.col("i")).alias("pos"), F.col("r.QID").alias("key"), where.alias("component"))
    glossary = details.where(_or_empty("g.QID") != "").select(
        "scan_id", "__at", F.col("g.QID").alias("key"), _or_empty("g.TITLE").alias("title"), _severity_or_3("g.SEVERITY").alias("severity"), F.lit(False).alias("diagnostic"),
        ensure_cvss3_prefix(F.regexp_extract(_or_empty("g.CVSS3_SCORE.CVSS3_BASE"), r"\(([^()]+)\)", 1)).alias("cvss_vector"), _or_empty("g.THREAT").alias("description"), _or_empty("g.IMPACT").alias("impact"), _or_empty("g.SOLUTION").alias("mitigation"),
        _id_refs("g.CVE_ID_LIST.CVE_ID", "g.VENDOR_REFERENCE_LIST.VENDOR_REFERENCE").alias("references"),
    )
    return _qualys(glossary_join(found, glossary, ["scan_id", "key"], "__at", _qualys_defaults()))


def qualys_occurrences(files: DataFrame) -> DataFrame:
    """Each of the three forms by its own parser, told apart by the root element."""
    root = F.regexp_extract("text", r"<(WAS_SCAN_REPORT|ASSET_DATA_REPORT|SCAN)\b", 1)
    scan, was, vm = (files.where(root == name) for name in ("SCAN", "WAS_SCAN_REPORT", "ASSET_DATA_REPORT"))
    return qualys_scan_occurrences(scan).unionByName(qualys_was_occurrences(was)).unionByName(qualys_vm_occurrences(vm))


#: What a TLS scan is checked for: field, plugin id, title, severity. Texts are this library's own.
TLS_PROTOCOLS = [
    ("ssl_2_0_cipher_suites", "sslyze:ssl_2_0", "SSL 2.0 Enabled", "critical"), ("ssl_3_0_cipher_suites", "sslyze:ssl_3_0", "SSL 3.0 Enabled (POODLE)", "high"),
    ("tls_1_0_cipher_suites", "sslyze:tls_1_0", "TLS 1.0 Enabled", "medium"), ("tls_1_1_cipher_suites", "sslyze:tls_1_1", "TLS 1.1 Enabled", "medium"),
]
PROTOCOL_FIX = "<p>Accept TLS 1.2 and TLS 1.3 only.</p>"


def predates_v5(text: Column) -> Column:
    """Whether a TLS scan export has a server in the shape of releases before 5."""
    servers = F.from_json(text, "server_scan_results array<struct<scan_result:string,scan_commands_results:string,server_info:string>>")["server_scan_results"]
    return F.coalesce(F.exists(servers, lambda s: s["scan_result"].isNull() & (s["scan_commands_results"].isNotNull() | s["server_info"].isNotNull())), F.lit(False))


def sslyze_occurrences(files: DataFrame) -> DataFrame:
    """Failed checks of each server and certificate deployment; checks and servers that ended in an error give none."""
    check = lambda name, fields: f"{name}:struct<status:string,result:struct<{fields}>>"
    deployment = (
        "struct<leaf_certificate_is_within_validity_period:boolean,leaf_certificate_subject_matches_hostname:boolean,path_validation_results:array<struct<verified_certificate_chain:string>>,"
        "received_chain:array<struct<public_key:struct<algorithm:string,key_size:int>>>>"
    )
    checks = ",".join([check(name, "accepted_cipher_suites:array<string>") for name, *_ in TLS_PROTOCOLS] + [
        check("heartbleed", "is_vulnerable_to_heartbleed:boolean"), check("robot", "robot_attack_enum:string"), check("openssl_ccs_injection", "is_vulnerable_to_ccs_injection:boolean"),
        check("tls_compression", "supports_compression:boolean"), check("certificate_info", f"certificate_deployments:array<{deployment}>"),
    ])
    schema = f"server_scan_results array<struct<scan_status:string,server_location:struct<hostname:string,ip_address:string,port:string>,scan_result:struct<{checks}>>>"
    rows = files.where(~predates_v5(F.col("text"))).select(F.col("path").alias("scan_id"), F.posexplode(F.from_json("text", schema)["server_scan_results"]).alias("s", "server"))
    rows = rows.where(F.coalesce(F.col("server.scan_status") != "ERROR", F.lit(True)))

    def result(name: str) -> Column:
        entry = F.col(f"server.scan_result.{name}")
        return F.when(F.coalesce(entry["status"] != "ERROR", F.lit(True)), entry["result"])

    def hit(condition: Column, key: str, title: str, severity: str, description: Column | str, mitigation: str) -> Column:
        told = description if isinstance(description, Column) else F.lit(description)
        return F.when(condition, F.struct(F.lit(key).alias("key"), F.lit(title).alias("title"), F.lit(severity).alias("severity"), told.alias("description"), F.lit(mitigation).alias("mitigation")))

    robot = F.coalesce(result("robot")["robot_attack_enum"], F.lit(""))
    server = [hit(F.size(result(name)["accepted_cipher_suites"]) > 0, key, title, severity, f"<p>The server accepts the outdated protocol: {title}.</p>", PROTOCOL_FIX) for name, key, title, severity in TLS_PROTOCOLS]
    server += [
        hit(result("heartbleed")["is_vulnerable_to_heartbleed"], "sslyze:heartbleed", "Heartbleed (CVE-2014-0160)", "critical", "<p>Server memory can be read from afar.</p>", "<p>Upgrade OpenSSL, then renew keys and certificates.</p>"),
        hit(robot.startswith("VULNERABLE"), "sslyze:robot", "ROBOT Attack", "high", F.concat(F.lit("<p>RSA key exchange gives an oracle: <code>"), robot, F.lit("</code></p>")), "<p>Offer key exchange with forward secrecy only.</p>"),
        hit(result("openssl_ccs_injection")["is_vulnerable_to_ccs_injection"], "sslyze:openssl_ccs", "OpenSSL CCS Injection (CVE-2014-0224)", "high", "<p>Weak keys can be forced on a connection.</p>", "<p>Upgrade OpenSSL.</p>"),
        hit(result("tls_compression")["supports_compression"], "sslyze:tls_compression", "TLS Compression Enabled (CRIME)", "medium", "<p>Compressed traffic can give secrets away.</p>", "<p>Turn TLS compression off.</p>"),
    ]

    def of_deployment(d: Column) -> Column:
        key = F.get(d["received_chain"], F.lit(0))["public_key"]
        weak = ((key["algorithm"] == "RSA") & (key["key_size"] < 2048)) | ((key["algorithm"] == "EC") & (key["key_size"] < 256))
        untrusted = F.exists(d["path_validation_results"], lambda p: F.coalesce(p["verified_certificate_chain"], F.lit("")).isin("", "[]", "false"))
        return F.array(
            hit(~d["leaf_certificate_is_within_validity_period"], "sslyze:cert_expired", "Expired TLS Certificate", "high", "<p>The certificate is outside its validity period.</p>", "<p>Renew the certificate.</p>"),
            hit(~d["leaf_certificate_subject_matches_hostname"], "sslyze:cert_hostname_mismatch", "TLS Certificate Hostname Mismatch", "medium", "<p>The certificate doesn't name this host.</p>", "<p>Use a certificate that names the host.</p>"),
            hit(untrusted, "sslyze:cert_untrusted", "Untrusted or Self-Signed TLS Certificate", "medium", "<p>Some trust store doesn't accept the chain.</p>", "<p>Use a certificate of a trusted authority, and serve the whole chain.</p>"),
            hit(weak, "sslyze:cert_weak_key", "Weak TLS Certificate Public Key", "medium", F.concat(F.lit("<p>The key is short: <code>"), key["algorithm"], F.lit(" "), key["key_size"].cast("string"), F.lit("-bit</code></p>")), "<p>Use RSA of 2048 bits, EC of 256 bits, or more.</p>"),
        )

    certificates = F.flatten(F.transform(result("certificate_info")["certificate_deployments"], of_deployment))
    hits = F.filter(F.concat(F.array(*server), F.coalesce(certificates, F.array().cast("array<struct<key:string,title:string,severity:string,description:string,mitigation:string>>"))), lambda h: h.isNotNull())
    place = F.col("server.server_location")
    where = F.concat(F.coalesce(F.when(place["hostname"] != "", place["hostname"]), place["ip_address"], F.lit("unknown")), F.lit(":"), F.coalesce(place["port"], F.lit("443")))
    return rows.select("scan_id", "s", where.alias("component"), F.posexplode(hits).alias("i", "h")).select(
        "scan_id", F.lit("sslyze").alias("scanner"), (F.col("s").cast("long") * (1 << 32) + F.col("i")).alias("pos"), F.col("h.key").alias("key"), F.col("h.title").alias("title"), severity_rank(F.col("h.severity")).alias("sev_rank"), "component",
        F.lit("").alias("cvss_vector"), F.lit("").alias("cwe"), F.col("h.description").alias("description"), F.lit("").alias("impact"), F.col("h.mitigation").alias("mitigation"), _refs(_none()).alias("references"), *_more(),
    )


#: Parsers by scanner; add one under a new name to take another format.
PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {"nessus": nessus_occurrences, "burp": burp_occurrences, "zap": zap_occurrences, "openvas": openvas_occurrences, "acunetix": acunetix_occurrences, "qualys": qualys_occurrences, "sslyze": sslyze_occurrences}


def store_routed(routed: DataFrame, folder: str) -> DataFrame:
    """``routed`` as a table of one partition a scanner: files are read, decoded and recognised once, and a parser reads its own partition only."""
    routed.write.mode("overwrite").partitionBy("scanner").parquet(folder)
    return routed.sparkSession.read.schema(routed.schema).parquet(folder)


def ingest(routed: DataFrame) -> DataFrame:
    """Raw occurrences of all routed files that have a parser: a branch a scanner, each over its own files.

    Each branch reads ``routed`` again; give it a table of ``store_routed`` where there are many files.
    """
    out = None
    for scanner, parser in PARSERS.items():
        part = parser(routed.where((F.col("status") == "ok") & (F.col("scanner") == scanner))).select(*OCCURRENCE)
        out = part if out is None else out.unionByName(part)
    return out


def findings(raw: DataFrame) -> DataFrame:
    """One finding a scan and key: highest severity, components in order of first sight, the highest confidence as a tag, all else of the first occurrence."""
    first = ["title", "cvss_vector", "cwe", "description", "impact", "mitigation", "references", "tags", "steps", "notes"]
    scale = F.coalesce(*[F.nullif(F.array_position(F.array(*map(F.lit, words)), F.col("confidence")), F.lit(0)) for words in CONFIDENCES.values()])
    merged = merge_occurrences(raw.withColumn("__level", scale), ["scan_id", "scanner", "key"], first=first, most=["__level"])
    word = F.coalesce(*[F.when(F.col("scanner") == scanner, F.try_element_at(F.array(*map(F.lit, words)), F.col("__level").cast("int"))) for scanner, words in CONFIDENCES.items()])
    tags = F.when(word.isNull(), F.col("tags")).otherwise(F.concat("tags", F.array(F.concat(F.lit("confidence:"), word))))
    return merged.withColumns({"title": collapse_whitespace(F.col("title")), "references": refs_to_html(F.col("references")), "tags": tags}).drop("__level")
