"""Documents exploded to lines, sections, references and tags, and the rules over them.

Every rule is a table of failures: rule_id, doc_id, line, message.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from findlake.functions.scoring import SEVERITIES, cvss_parse
from findlake.functions.text import decode_ref_path, expected_kind, lines, mask_term, tags_problem

#: Phrases that no document may hold.
BANNED_PHRASES = [
    "as an ai", "as an ai language model", "i have updated", "i've updated", "as requested", "per your instructions", "let me know if you'd like", "i apologize for the confusion",
]
#: White space that a line must not end with.
TRAILING = "[\\t-\\r\\x1c-\\x20\\x85\\xa0\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]\\z"
#: Zero-width and direction marks.
INVISIBLE = "[\\x{200B}-\\x{200F}\\x{202A}-\\x{202E}\\x{2060}\\x{2066}-\\x{2069}\\x{FEFF}]"
#: The fields of a finding's frontmatter, those that it must have, and the types of findings.
FINDING_FIELDS = ["severity", "finding_type", "cvss", "cwe", "tags", "affected_entities"]
REQUIRED_FIELDS = ["severity", "finding_type"]
FINDING_TYPES = ["network", "physical", "wireless", "web", "mobile", "cloud", "host"]
FAILURE = ["rule_id", "doc_id", "line", "message"]
#: A bracketed text, with brackets inside to one depth.
BRACKETED = r"\[((?:[^\[\]\n]++|\[[^\[\]\n]*+\])*+)\]"
TITLE = r"(?:\s+(?:\"([^\"\n]*)\"|'([^'\n]*)'))?"
#: An inline link or embed, one by label (full or collapsed), an autolink, and the line that defines a label.
REFERENCE = rf"(!?){BRACKETED}\(\s*(?:<([^<>\n]*)>|((?:[^\s()<>]++|\([^\s()]*+\))++)){TITLE}\s*\)"
LABELLED = rf"(!?){BRACKETED}\[([^\[\]\n]*+)\]"
AUTOLINK = r"<([A-Za-z][A-Za-z0-9+.-]+:[^\s<>]*)>"
DEFINITION = rf"^ {{0,3}}\[([^\[\]\n]+)\]:\s*(?:<([^<>\n]*)>|(\S+)){TITLE}\s*$"
#: A fenced block of a text whose lines end with LF: up to a fence of the same mark that is no shorter, or to the end.
FENCED = r"(?md)^ {0,3}(`{3,})[^`\n]*\n(?s:.*?)(?:^ {0,3}\1`*[ \t]*\n|\z)|^ {0,3}(~{3,})[^\n]*\n(?s:.*?)(?:^ {0,3}\2~*[ \t]*\n|\z)"
#: Marks of raw text in templates.
RAW_OPEN = r"\{%-?\s*raw\s*-?%\}"
RAW_CLOSE = r"\{%-?\s*endraw\s*-?%\}"


def explode_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", more: Sequence[str] = (), fences: bool = False) -> DataFrame:
    """``doc_id, line, content`` and the columns ``more`` of the document: numbered from 1; empty texts have no line.

    With ``fences`` also ``in_code``: whether a line is a fence of a code block or stands inside one.
    """
    if not fences:
        return docs.select(F.col(id_col).alias("doc_id"), *more, F.posexplode(lines(F.col(text_col)))).select("doc_id", (F.col("pos") + 1).alias("line"), F.col("col").alias("content"), *more)
    marked = docs.select(F.col(id_col).alias("doc_id"), *more, F.posexplode(_fence_marks(lf_text(F.col(text_col)))))
    return marked.select("doc_id", (F.col("pos") + 1).alias("line"), F.expr("substring(col, 2)").alias("content"), *more, F.col("col").startswith("1").alias("in_code"))


def lf_text(text: Column) -> Column:
    """The lines of a text, each ended by LF; empty for one without lines."""
    return _bound(lines(text), lambda found: F.when(F.size(found) > 0, F.concat(F.array_join(found, "\n"), F.lit("\n"))).otherwise(""))


def _fence_marks(text: Column) -> Column:
    """The lines of a text that end with LF, each with 1 in front if it is in a fenced block, else 0.

    The blocks are found one after the other within the text, so a document of any size needs no window over its lines.
    """
    mark = lambda part, flag: F.when(part == "", "").otherwise(F.regexp_replace(part, "(?md)^", flag))
    parts = lambda t: F.zip_with(F.split(t, FENCED, -1), F.regexp_extract_all(t, F.lit(FENCED), F.lit(0)), lambda plain, block: F.concat(mark(plain, "0"), mark(F.coalesce(block, F.lit("")), "1")))
    whole = lambda t: F.when(t.contains("```") | t.contains("~~~"), F.array_join(parts(t), "")).otherwise(mark(t, "0"))
    return _bound(text, lambda t: _bound(F.split(whole(t), "\n", -1), lambda found: F.slice(found, F.lit(1), F.size(found) - 1)))


def mark_fences(line_rows: DataFrame) -> DataFrame:
    """``line_rows`` with ``in_code``: fence lines and what is between them. Rows that don't bring it are put together again by document."""
    if "in_code" in line_rows.columns:
        return line_rows
    whole = line_rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line", "content"))).alias("__l"))
    text = F.concat(F.array_join(F.col("__l")["content"], "\n"), F.lit("\n"))
    told = F.transform(_fence_marks(text), lambda m: m.startswith("1"))
    flags = whole.select("doc_id", F.inline(F.arrays_zip(F.col("__l")["line"].alias("line"), told.alias("in_code"))))
    return line_rows.join(flags, ["doc_id", "line"])


def headings(line_rows: DataFrame) -> DataFrame:
    """``doc_id, line, level, title`` outside code."""
    rows = mark_fences(line_rows).where(~F.col("in_code") & F.col("content").rlike(r"^#{1,6} "))
    return rows.select("doc_id", "line", F.length(F.regexp_extract("content", r"^(#{1,6}) ", 1)).alias("level"), F.trim(F.regexp_replace("content", r"^#{1,6} ", "")).alias("title"))


def sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, section, start_line, n_lines, content`` of level-two headings; lines before the first belong to null.

    A finding's sections are cut wherever a line starts with the mark of the heading, inside code too. Texts are cut as they are;
    only sections, a few a document, are put in order to count their lines.
    """
    cut = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(lf_text(F.col(text_col)), r"(?md)^## ", -1)).alias("k", "part"))
    head = F.when(F.col("k") > 0, F.substring_index("part", "\n", 1))
    told = cut.select("doc_id", "k", F.trim(head).alias("section"), F.when(F.col("k") > 0, F.regexp_replace("part", r"^[^\n]*\n", "")).otherwise(F.col("part")).alias("body"))
    told = told.withColumn("n_lines", (F.length("body") - F.length(F.replace("body", F.lit("\n"), F.lit("")))).cast("long"))
    before = F.sum(F.col("n_lines") + (F.col("k") > 0).cast("int")).over(Window.partitionBy("doc_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1))
    start = F.when(F.col("k") > 0, (F.coalesce(before, F.lit(0)) + 1).cast("int"))
    return told.withColumn("start_line", start).where("k > 0 or n_lines > 0").select("doc_id", "section", "start_line", "n_lines", F.regexp_replace("body", r"\n\z", "").alias("content"))


def _in_list(found: Column) -> Column:
    """Of marked lines (1 in front: code) whether each stands in a list item, as an array.

    A letter a line: L starts an item, I is indented, B blank, O other text, X a heading, quote, rule or code. An item goes on over
    indented lines, over text right after one of its lines, and over blank lines before either of L and I.
    """
    kind = lambda m: (
        F.when(m.rlike(r"^.\s*$"), "B").when(m.rlike(r"^0 {0,3}(?:[-*+]|\d{1,9}[.)])\s+\S"), F.when(m.rlike(r"^0 {0,3}(?:[-*_]\s*){3,}$"), "X").otherwise("L")).when(m.rlike(r"^.(?: {2,}|\t)"), "I")
        .when(m.startswith("1") | m.rlike(r"^0 {0,3}(?:#{1,6} |>)"), "X").otherwise("O")
    )
    letters = F.array_join(F.transform(found, kind), "")
    item = r"L[^X]*?(?=B+[OX]|X|\z)"
    flags = F.zip_with(F.split(letters, item, -1), F.regexp_extract_all(letters, F.lit(item), F.lit(0)), lambda out, own: F.concat(F.repeat(F.lit("0"), F.length(out)), F.repeat(F.lit("1"), F.coalesce(F.length(own), F.lit(0)))))
    return F.transform(F.split(F.array_join(flags, ""), ""), lambda c: c == "1")


def reference_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, line, content, in_code, in_list_item`` of the lines of each document."""
    found = docs.select(F.col(id_col).alias("doc_id"), _fence_marks(lf_text(F.col(text_col))).alias("__m"))
    rows = found.select("doc_id", F.posexplode(F.arrays_zip(F.col("__m"), _in_list(F.col("__m")).alias("__list"))).alias("pos", "x"))
    return rows.select("doc_id", (F.col("pos") + 1).alias("line"), F.expr("substring(x.__m, 2)").alias("content"), F.col("x.__m").startswith("1").alias("in_code"), F.coalesce("x.__list", F.lit(False)).alias("in_list_item"))


#: A code span of a line: closed by a run of as many marks.
CODE_SPAN = r"(`++)(.+?)(?<!`)\1(?!`)"


def _calm(line: Column) -> Column:
    """A line whose code spans keep their text, but no mark that a reference is made of."""
    spans = F.regexp_extract_all(line, F.lit(CODE_SPAN), F.lit(2))
    calm = F.array_join(F.zip_with(F.split(line, CODE_SPAN, -1), spans, lambda out, own: F.concat(out, F.coalesce(F.translate(own, "[]()<>!", ""), F.lit("")))), "")
    return F.when(line.contains("`"), calm).otherwise(line)


def _label(label: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(label, r"\s+", " ")))


def _flat(caption: Column) -> Column:
    """The text that a reader sees of a caption."""
    shown = F.regexp_replace(F.regexp_replace(caption, r"!?\[([^\[\]]*)\](?:\([^()]*\)|\[[^\[\]]*\])", "$1"), r"\*+|`+|(?<!\w)_+|_+(?!\w)", "")
    return shown


def references(line_rows: DataFrame) -> DataFrame:
    """``doc_id, line, ord, kind, caption, ref_path, title, standalone, in_list_item`` of links and embeds outside code.

    Inline ones with brackets in the caption and titles, embeds inside a link's caption, ones by label (full, collapsed or just the label)
    with their definition anywhere in the document (of equal labels the first), and autolinks. A label without a definition is plain
    text. An embed is standalone if it is its line; a line's references are numbered from 0. Lines come from ``explode_lines``
    or, with the context of lists, ``reference_lines``.
    """
    marked = F.col("content").contains("[") | F.col("content").contains("<")
    rows = mark_fences(line_rows).where(~F.col("in_code") & marked)
    if "in_list_item" not in rows.columns:
        rows = rows.withColumn("in_list_item", F.lit(None).cast("boolean"))
    pick = lambda m, pattern, *groups: F.coalesce(*[F.nullif(F.regexp_extract(m, pattern, g), F.lit("")) for g in groups], F.lit(""))
    single = rf"(!?){BRACKETED}(?:\[([^\[\]\n]*+)\])?"
    each = lambda form, source, pattern: F.transform(F.regexp_extract_all(source, F.lit(pattern), F.lit(0)), lambda m: F.struct(F.lit(form).alias("form"), m.alias("m")))

    def forms(plain: Column) -> Column:
        """What a line holds, in one array: its definition, or its references; inline forms are taken out before what is written by label is looked for."""
        used = F.concat(each("inline", plain, REFERENCE), each("auto", F.regexp_replace(plain, REFERENCE, ""), AUTOLINK), each("named", F.regexp_replace(F.regexp_replace(plain, REFERENCE, " "), AUTOLINK, " "), single))
        told = F.when(plain.rlike(DEFINITION), F.array(F.struct(F.lit("defined").alias("form"), plain.alias("m")))).otherwise(used)
        return F.transform(told, lambda x: F.struct(x["form"].alias("form"), x["m"].alias("m"), F.instr(plain, x["m"]).alias("at")))

    found = rows.select("doc_id", "line", "in_list_item", F.trim("content").alias("whole"), F.inline(_bound(_calm(F.col("content")), forms)))
    # embeds in the caption of a link come after it, as rows of their own
    embeds = F.regexp_extract_all(F.regexp_extract("m", REFERENCE, 2), F.lit(r"!\[[^\[\]]*\]\([^()\s]*(?:\s+\"[^\"]*\")?\)"), F.lit(0))
    inside = F.when((F.col("form") == "inline") & ~F.col("m").startswith("!"), embeds).otherwise(F.array().cast("array<string>"))
    own = F.struct("form", "m", "at")
    found = found.select("doc_id", "line", "in_list_item", "whole", F.inline(F.concat(F.array(own), F.transform(inside, lambda m: F.struct(F.lit("inline").alias("form"), m.alias("m"), (F.col("at") + 1).alias("at"))))))
    of = lambda inline, auto, named, defined: F.when(F.col("form") == "inline", inline).when(F.col("form") == "auto", auto).when(F.col("form") == "named", named).otherwise(defined)
    none, link, m = F.lit(None).cast("string"), F.regexp_extract("m", AUTOLINK, 1), F.col("m")
    read = found.select(
        "doc_id", "line", "in_list_item", "whole", "form", "m", "at", F.when((F.col("form") != "auto") & m.startswith("!"), "embed").otherwise("cross_reference").alias("kind"),
        of(F.regexp_extract("m", REFERENCE, 2), link, F.regexp_extract("m", single, 2), none).alias("raw"), of(pick(m, REFERENCE, 3, 4), link, none, pick(m, DEFINITION, 2, 3)).alias("path"),
        of(pick(m, REFERENCE, 5, 6), F.lit(""), none, pick(m, DEFINITION, 4, 5)).alias("title"), of(none, none, _label(pick(m, single, 3, 2)), _label(F.regexp_extract("m", DEFINITION, 1))).alias("label"),
    )
    # a document's references, which come from one text, meet their definitions and are numbered in one shuffle
    first = F.min(F.when(F.col("form") == "defined", F.struct("line", "path", "title"))).over(Window.partitionBy("doc_id", "label"))
    known = read.repartition("doc_id").withColumn("d", first).where("form <> 'defined' and (form <> 'named' or doc_id is not null and d is not null)")
    known = known.withColumns({"path": F.when(F.col("form") == "named", F.col("d.path")).otherwise(F.col("path")), "title": F.when(F.col("form") == "named", F.col("d.title")).otherwise(F.col("title"))})
    order = F.row_number().over(Window.partitionBy("doc_id", "line").orderBy("at", "m")) - 1
    alone = (F.col("kind") == "embed") & (F.col("whole") == F.col("m"))
    return known.select("doc_id", "line", order.alias("ord"), "kind", _flat(F.col("raw")).alias("caption"), decode_ref_path(F.col("path")).alias("ref_path"), "title", alone.alias("standalone"), "in_list_item")


def unparsed_references(line_rows: DataFrame) -> DataFrame:
    """``doc_id, unparsed``: how many brackets followed by a target or a label no form of ``references`` reads, of documents with any."""
    rows = mark_fences(line_rows).where("not in_code").withColumn("plain", _calm(F.col("content")))
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace("plain", REFERENCE, " "), LABELLED, " "), r"\\.", "")
    return rows.groupBy("doc_id").agg(F.sum(F.size(F.regexp_extract_all(rest, F.lit(r"\]\(|\]\["), F.lit(0)))).alias("unparsed")).where("unparsed > 0")


def links(docs: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """``id, url, scheme`` of every href; scheme is empty for relative ones."""
    found = docs.select(F.col(id_col).alias("doc_id"), F.explode(F.regexp_extract_all(html_col, F.lit(r'(?i)href="([^"]*)"'), 1)).alias("url"))
    return found.withColumn("scheme", F.lower(F.regexp_extract("url", r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)))


def html_tags(docs: DataFrame, id_col: str, html_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.explode(F.regexp_extract_all(html_col, F.lit(r"<([A-Za-z][A-Za-z0-9]*)"), 1)).alias("tag")).withColumn("tag", F.lower("tag"))


def frontmatter_split(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``header, body``; header is null where the text doesn't start with a fenced block."""
    fenced = r"(?s)\A---\n(.*?\n)?---\n?(.*)\z"
    is_there = F.col(text_col).rlike(fenced)
    return docs.withColumn("header", F.when(is_there, F.regexp_extract(text_col, fenced, 1))).withColumn("body", F.when(is_there, F.regexp_extract(text_col, fenced, 2)).otherwise(F.col(text_col)))


#: A plain field line of a header: no indent, a name, a colon.
FIELD_LINE = r"^(?:\"[^\"\n]*\"|'[^'\n]*'|[^\s#\-\[\]{}&*!|>%@`\"',?:][^:\n]*):(?:\s.*)?$"


def _without_comment(value: Column) -> Column:
    """A value without the comment after it; a mark inside quotes is none."""
    quoted = F.regexp_extract(value, r"""^("(?:[^"\\]++|\\.)*+"|'(?:[^']++|'')*+')\s*(?:#.*)?$""", 1)
    return F.trim(F.when(quoted != "", quoted).otherwise(F.regexp_replace(value, r"(?:^|\s)#.*$", "")))


def _unquoted(value: Column) -> Column:
    """A scalar: quotes off and their escapes read; ~ and null are empty."""
    double = F.replace(F.replace(F.replace(F.replace(F.substring(value, F.lit(2), F.length(value) - 2), F.lit("\\n"), F.lit("\n")), F.lit("\\t"), F.lit("\t")), F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))
    single = F.replace(F.substring(value, F.lit(2), F.length(value) - 2), F.lit("''"), F.lit("'"))
    return F.when(value.rlike(r'^".*"$'), double).when(value.rlike(r"^'.*'$"), single).when(value.isin("~", "null", "Null", "NULL"), "").otherwise(value)


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is named there."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def header_fields(header: Column) -> Column:
    """The fields of a header as struct(fields map<string, string>, lists map<string, array<string>>, repeated array<string>, error).

    Read are scalars, plain or in quotes, over several lines, as literal (|) or folded (>) blocks; lists of either form; and maps
    of scalars one level down, whose fields are named ``key.name``. ``fields`` has every field, lists as an empty text. Of repeated keys
    the last counts, and they are named in ``repeated``. ``error`` says what can't be read: text that is no field, a quote or
    bracket that stays open, an indent by tabs, or a form beyond these; a header that is null has no fields and no error.
    """
    text = F.regexp_replace(header, r"\n\z", "")
    cut = F.split(text, rf"(?md)^(?={FIELD_LINE[1:]})", -1)
    name = lambda e: _unquoted(F.trim(F.regexp_extract(e, r"^([^:\n]+):", 1)))
    body = lambda e: F.regexp_replace(e, r"^[^:\n]+:", "")

    def entry(e: Column) -> Column:
        return _bound(F.struct(name(e).alias("key"), F.split(body(e), "\n", -1).alias("rows")), lambda x: _bound(F.struct(
            x["key"].alias("key"), _without_comment(F.trim(x["rows"][0])).alias("inline"), F.slice(x["rows"], F.lit(2), F.size(x["rows"])).alias("raw"),
            F.filter(F.slice(x["rows"], F.lit(2), F.size(x["rows"])), lambda r: ~r.rlike(r"^\s*(?:#.*)?$")).alias("below"),
        ), field))

    def field(x: Column) -> Column:
        key, inline, raw, below = x["key"], x["inline"], x["raw"], x["below"]
        block = inline.rlike(r"^[|>][+-]?$")
        indent = F.array_min(F.transform(F.filter(raw, lambda r: F.trim(r) != ""), lambda r: F.length(F.regexp_extract(r, "^ *", 0))))
        dedented = F.transform(raw, lambda r: F.substring(r, indent + 1, F.length(r)))
        literal = F.regexp_replace(F.when(inline.startswith("|"), F.array_join(dedented, "\n")).otherwise(F.array_join(dedented, " ")), r"\s+\z", "")
        is_list = (inline == "") & (F.size(below) > 0) & F.forall(below, lambda r: r.rlike(r"^\s*-(?:\s|$)"))
        is_map = (inline == "") & (F.size(below) > 0) & F.forall(below, lambda r: r.rlike(r"^ +[^\s#\-:][^:]*:(?:\s|$)"))
        is_flow = inline.rlike(r"^\[.*\]$")
        flow = F.filter(F.regexp_extract_all(F.substring(inline, F.lit(2), F.length(inline) - 2), F.lit(r"""\s*("[^"]*"|'[^']*'|[^,]*)\s*(?:,|$)"""), F.lit(1)), lambda x: F.trim(x) != "")
        items = F.when(is_list, F.transform(below, lambda r: _unquoted(_without_comment(F.regexp_replace(r, r"^\s*-\s*", ""))))).when(is_flow, F.transform(flow, lambda x: _unquoted(F.trim(x))))
        more = F.array_join(F.transform(below, lambda r: F.trim(r)), " ")
        scalar = _unquoted(F.trim(F.concat(inline, F.lit(" "), F.when(is_list | is_map, "").otherwise(more))))
        value = F.when(block, literal).when(is_list | is_flow | is_map, "").otherwise(scalar)
        inner = F.when(is_map, F.transform(below, lambda r: F.struct(F.concat(key, F.lit("."), F.trim(F.regexp_extract(r, r"^ +([^:]+):", 1))).alias("key"), _unquoted(_without_comment(F.trim(F.regexp_replace(r, r"^[^:]+:", "")))).alias("value"))))
        whole = F.trim(F.concat(inline, F.lit(" "), more))
        open_quote = ~block & (whole.rlike(r"""^"(?:[^"\\]++|\\.)*+$""") | whole.rlike(r"^'(?:[^']++|'')*+$"))
        problem = (
            F.when(F.exists(raw, lambda r: r.rlike(r"^ *\t")) & ~block, "indent by tab").when(open_quote, "open quote").when(~block & inline.startswith("[") & ~is_flow, "open bracket").when(~block & inline.rlike(r"^[{&*!%@`]"), "unread form")
            .when((inline == "") & (F.size(below) > 0) & ~is_list & ~is_map & F.exists(below, lambda r: r.rlike(r"^\s*-(?:\s|$)") | r.rlike(r"^ +[^\s#:]+:(?:\s|$)")), "unread form").when(~block & ~is_list & F.exists(below, lambda r: ~r.startswith(" ")), "not a field")
        )
        return F.struct(key.alias("key"), value.alias("value"), items.alias("items"), inner.alias("inner"), F.concat(key, F.lit(": "), problem).alias("problem"))

    pair = "array<struct<key:string,value:string>>"
    keys = lambda xs: F.transform(xs, lambda x: x["key"])
    last = lambda xs: _bound(F.struct(xs.alias("xs"), keys(xs).alias("keys")), lambda b: F.filter(b["xs"], lambda x, i: ~F.array_contains(F.slice(b["keys"], i + 2, F.size(b["keys"])), x["key"])))

    def told(b: Column) -> Column:
        entries, kept = b["entries"], b["kept"]
        inner = F.flatten(F.transform(kept, lambda x: F.coalesce(last(x["inner"]), F.array().cast(pair))))
        fields = F.map_from_entries(F.concat(F.transform(kept, lambda x: F.struct(x["key"].alias("key"), x["value"].alias("value"))), inner))
        lists = F.map_from_entries(F.transform(F.filter(kept, lambda x: x["items"].isNotNull()), lambda x: F.struct(x["key"], x["items"])))
        repeated = F.array_distinct(F.filter(keys(entries), lambda k: F.size(F.filter(entries, lambda o: o["key"] == k)) > 1))
        problems = F.filter(F.transform(entries, lambda x: x["problem"]), lambda p: p.isNotNull())
        stray = F.concat(F.lit("not a field: "), F.substring(F.regexp_replace(b["front"], r"\A\s+|\s+\z", ""), 1, 60))
        return F.struct(fields.alias("fields"), lists.alias("lists"), repeated.alias("repeated"), F.coalesce(stray, F.get(problems, F.lit(0))).alias("error"))

    is_field = lambda e: e.rlike(rf"(?md)\A{FIELD_LINE[1:]}")
    front = F.get(F.filter(cut, lambda e: ~is_field(e) & F.exists(F.split(e, "\n", -1), lambda r: ~r.rlike(r"^\s*(?:#.*)?$"))), F.lit(0))
    read = F.struct(F.transform(F.filter(cut, is_field), entry).alias("entries"), front.alias("front"))
    whole = _bound(read, lambda x: _bound(F.struct(x["entries"].alias("entries"), last(x["entries"]).alias("kept"), x["front"].alias("front")), told))
    return F.when(header.isNotNull(), whole)


def finding_headers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tier_col: str = "tier") -> DataFrame:
    """``doc_id, tier, fields, cwe, tags, repeated, error`` of findings' texts, for ``frontmatter_rules``; texts without a header have no fields."""
    split = frontmatter_split(docs.select(F.col(id_col).alias("doc_id"), F.col(tier_col).alias("tier"), F.col(text_col).alias("text")))
    read = split.select("doc_id", "tier", header_fields(F.col("header")).alias("h"))
    fields, lists = F.coalesce("h.fields", F.create_map().cast("map<string,string>")), F.col("h.lists")
    vector = F.try_element_at(fields, F.lit("cvss.vector"))
    flat = F.map_filter(fields, lambda k, _: ~k.contains(".") & (k != "cvss"))
    with_vector = F.when(F.map_contains_key(fields, F.lit("cvss")), F.map_concat(flat, F.create_map(F.lit("cvss"), F.coalesce(vector, F.try_element_at(fields, F.lit("cvss")))))).otherwise(flat)
    numbers = F.transform(F.coalesce(F.try_element_at(lists, F.lit("cwe")), F.array().cast("array<string>")), lambda c: F.regexp_extract(c, r"^(?i:CWE-)?0*(\d{1,9})$", 1).try_cast("int"))
    return read.select("doc_id", "tier", with_vector.alias("fields"), F.array_compact(numbers).alias("cwe"), F.coalesce(F.try_element_at(lists, F.lit("tags")), F.array().cast("array<string>")).alias("tags"), F.coalesce("h.repeated", F.array().cast("array<string>")).alias("repeated"), F.col("h.error").alias("error"))


#: The elements that a record's HTML may hold, and the attributes that are kept of each.
KEPT_TAGS = "p ul ol li div pre blockquote table thead tbody tfoot tr th td strong code em a br span".split()
KEPT_ATTRIBUTES = {"a": ["href", "rel", "target", "title"], "span": ["data-color", "style"], "ol": ["start", "type"], "div": ["class"], "pre": ["class", "spellcheck"], "code": ["class"]}
START_TAG = r"""<([A-Za-z][A-Za-z0-9-]*)((?:[^<>"'/]++|/(?!>)|"[^"]*"|'[^']*')*+)/?>"""
ATTRIBUTE = r"""([^\s=<>"'/]+)(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'<>]+))?"""


def start_tags(docs: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """``doc_id, tag, attributes`` (names in lower case) of every start tag outside comments, scripts and styles."""
    plain = F.regexp_replace(F.regexp_replace(F.col(html_col), r"(?s)<!--.*?-->", ""), r"(?is)(<(script|style)\b[^>]*>).*?(</\2\s*>)", "$1$3")
    found = docs.select(F.col(id_col).alias("doc_id"), F.explode(F.regexp_extract_all(plain, F.lit(START_TAG), F.lit(0))).alias("m"))
    return found.select("doc_id", F.lower(F.regexp_extract("m", START_TAG, 1)).alias("tag"), F.transform(F.regexp_extract_all(F.regexp_extract("m", START_TAG, 2), F.lit(ATTRIBUTE), F.lit(1)), lambda a: F.lower(a)).alias("attributes"))


def html_losses(docs: DataFrame, id_col: str, html_col: str, tags: Sequence[str] = KEPT_TAGS, attributes: dict[str, Sequence[str]] = KEPT_ATTRIBUTES) -> DataFrame:
    """The loss report of each page: doc_id, n_tags, n_outside, outside, n_dropped, dropped.

    ``outside`` are the different elements that the vocabulary lacks, ``dropped`` the attributes (``tag@name``) of known elements
    that aren't kept, both in order; the numbers count every one. A page without a tag has no row. The vocabulary is the caller's
    fixed list and is broadcast; rows meet it in anti-joins, and counts are made before they are shuffled.
    """
    spark = docs.sparkSession
    found = start_tags(docs, id_col, html_col)
    known = F.broadcast(spark.createDataFrame([(t,) for t in tags], "tag string"))
    kept = F.broadcast(spark.createDataFrame([(t, a) for t, names in attributes.items() for a in names], "tag string, attribute string"))
    outside = found.join(known, "tag", "left_anti").select("doc_id", F.lit("outside").alias("loss"), F.col("tag").alias("what"))
    each = found.join(known, "tag", "left_semi").select("doc_id", "tag", F.explode("attributes").alias("attribute")).join(kept, ["tag", "attribute"], "left_anti")
    lost = outside.unionByName(each.select("doc_id", F.lit("dropped").alias("loss"), F.concat_ws("@", "tag", "attribute").alias("what")))
    counted = lost.groupBy("doc_id", "loss", "what").agg(F.count("*").alias("n")).unionByName(found.groupBy("doc_id").agg(F.count("*").alias("n")).select("doc_id", F.lit("all").alias("loss"), F.lit("").alias("what"), "n"))
    number = lambda loss: F.coalesce(F.sum(F.when(F.col("loss") == loss, F.col("n"))), F.lit(0))
    names = lambda loss: F.array_join(F.array_sort(F.collect_list(F.when(F.col("loss") == loss, F.col("what")))), ",")
    return counted.groupBy("doc_id").agg(number("all").alias("n_tags"), number("outside").alias("n_outside"), names("outside").alias("outside"), number("dropped").alias("n_dropped"), names("dropped").alias("dropped"))


def _word_pattern(phrase: str) -> str:
    import re

    return r"(?i)(?U)(?<!\w)" + r"\s+".join(re.escape(w) for w in phrase.split()) + r"(?!\w)"


def scan_phrases(line_rows: DataFrame, phrases: Sequence[str] = BANNED_PHRASES) -> DataFrame:
    """``doc_id, line, phrase``: one pattern of all phrases goes before the single ones."""
    any_ = "|".join(f"(?:{_word_pattern(p)})" for p in phrases)
    each = F.array_compact(F.array(*[F.when(F.col("content").rlike(_word_pattern(p)), F.lit(p)) for p in phrases]))
    return line_rows.where(F.col("content").rlike(any_)).select("doc_id", "line", F.explode(each).alias("phrase"))


def scan_terms(line_rows: DataFrame, terms: Sequence[tuple[str, str | None]], path: str = "path") -> DataFrame:
    """Confidential ``terms`` (term, allowed path prefix or None) outside their prefix, masked. Prefixes match whole segments."""
    found = []
    for term, allowed in terms:
        hit = F.col("content").rlike(_word_pattern(term))
        if allowed:
            hit = hit & ~((F.col(path) == allowed) | F.col(path).startswith(f"{allowed.rstrip('/')}/"))
        found.append(F.when(hit, mask_term(F.lit(term))))
    return line_rows.select("doc_id", "line", F.explode(F.array_compact(F.array(*found))).alias("masked"))


def raw_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ord, literal, piece, closed``: a text cut where template marks open and close raw text; marks are left out.

    Inside raw text an opening mark has no effect, outside a closing one; raw text that nothing closes goes on to the end. ``closed``
    is null outside. Empty pieces are left out. Pieces are found within the text, wherever lines end.
    """
    block = rf"(?U){RAW_OPEN}((?s:.*?))({RAW_CLOSE}|\z)"
    text = F.col(text_col)
    gaps, inner, ends = F.split(text, block, -1), F.regexp_extract_all(text, F.lit(block), F.lit(1)), F.regexp_extract_all(text, F.lit(block), F.lit(2))
    none = F.lit(None).cast("boolean")
    outside = lambda piece: F.struct(F.lit(False).alias("literal"), F.regexp_replace(piece, f"(?U){RAW_CLOSE}", "").alias("piece"), none.alias("closed"))
    inside = lambda x: F.struct(F.lit(True).alias("literal"), F.regexp_replace(x["i"], f"(?U){RAW_OPEN}", "").alias("piece"), (x["e"] != "").alias("closed"))
    blocks = F.arrays_zip(inner.alias("i"), ends.alias("e"))
    pieces = F.flatten(F.zip_with(gaps, blocks, lambda g, x: F.when(x.isNull(), F.array(outside(g))).otherwise(F.array(outside(g), inside(x)))))
    found = F.filter(pieces, lambda p: p["piece"] != "")
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(found).alias("ord", "p")).select("doc_id", "ord", "p.*")


# Rules


def failure(rows: DataFrame, rule_id: str, message: Column | str, line: Column | None = None) -> DataFrame:
    text = F.lit(message) if isinstance(message, str) else message
    return rows.select(F.lit(rule_id).alias("rule_id"), "doc_id", (F.lit(None).cast("int") if line is None else line.cast("int")).alias("line"), text.alias("message"))


def line_hygiene(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A carriage return anywhere (once a document), white space at the end of a line, and a wrong end of file; an empty file is fine."""
    one = lambda rule, message, line: F.struct(F.lit(rule).alias("rule_id"), line.cast("int").alias("line"), F.lit(message).alias("message"))
    none = F.lit(None)

    def found(t: Column) -> Column:
        # only the last letter of a line is looked at; a text is read once, whatever it is made of
        rows = F.split(F.replace(t, F.lit("\r\n"), F.lit("\n")), "\n")
        blank = F.transform(rows, lambda r, i: F.when(F.substring(r, -1, 1).rlike(TRAILING), one("WIKI-010", "trailing whitespace", i + 1)))
        end = (t != "") & (~t.endswith("\n") | t.endswith("\n\n"))
        return F.array_compact(F.concat(F.array(F.when(t.contains("\r"), one("WIKI-009", "carriage return", none))), blank, F.array(F.when(end, one("WIKI-011", "wrong end of file", none)))))

    return docs.select(F.col(id_col).alias("doc_id"), F.inline(_bound(F.col(text_col), found))).select(*FAILURE)


def control_characters(line_rows: DataFrame) -> DataFrame:
    """A failure for each zero-width or direction mark, with its code point."""
    found = line_rows.where(F.octet_length("content") > F.length("content")).select("doc_id", "line", F.explode(F.regexp_extract_all("content", F.lit(INVISIBLE), 0)).alias("c"))  # no mark is ASCII
    return failure(found, "WIKI-008", F.concat(F.lit("U+"), F.lpad(F.hex(F.expr("ascii(c)")), 4, "0")), F.col("line"))


def _folded(column: str) -> Column:
    """Without regard to case; upper case first, as it spells out letters that have no single capital."""
    return F.lower(F.upper(F.trim(column)))


def heading_rules(heads: DataFrame, titles: DataFrame) -> DataFrame:
    """Skipped levels (the first heading is held against 0) and a first heading that repeats the title in any case."""
    order = Window.partitionBy("doc_id").orderBy("line")
    seen = heads.withColumn("__before", F.lag("level", 1, 0).over(order)).withColumn("__k", F.row_number().over(order))
    skip = failure(seen.where("level > __before + 1"), "WIKI-012", F.concat(F.lit("level "), F.col("__before").cast("string"), F.lit(" to "), F.col("level").cast("string")), F.col("line"))
    same = seen.where("__k = 1").join(titles.select("doc_id", F.col("title").alias("__t")), "doc_id").where(_folded("title") == _folded("__t"))
    return skip.unionByName(failure(same, "WIKI-013", "heading repeats the title", F.col("line")))


def section_rules(found: DataFrame, docs: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Missing, unknown, repeated and misplaced sections of each document (doc_id, section, start_line)."""
    place = F.array_position(F.array(*[F.lit(s) for s in wanted]), F.col("section"))
    named = found.where("section is not null").withColumn("__place", place)
    grid = docs.select("doc_id").distinct().select("doc_id", F.explode(F.array(*[F.lit(s) for s in wanted])).alias("section"))
    missing = failure(grid.join(named.select("doc_id", "section"), ["doc_id", "section"], "left_anti"), "FND-009", F.col("section"))
    unknown = failure(named.where("__place = 0"), "FND-010", F.col("section"), F.col("start_line"))
    again = named.withColumn("__k", F.row_number().over(Window.partitionBy("doc_id", "section").orderBy("start_line")))
    twice = failure(again.where("__k > 1"), "FND-011", F.col("section"), F.col("start_line"))
    order = named.where("__place > 0").withColumn("__high", F.max("__place").over(Window.partitionBy("doc_id").orderBy("start_line").rowsBetween(Window.unboundedPreceding, -1)))
    return missing.unionByName(unknown).unionByName(twice).unionByName(failure(order.where("__place < __high"), "FND-012", F.col("section"), F.col("start_line")))


def link_scheme_rule(refs: DataFrame, allowed: Sequence[str] = ("http", "https", "mailto")) -> DataFrame:
    """WIKI-006: links and images of ``references`` whose target has a scheme that isn't allowed; targets without one are relative."""
    scheme = F.lower(F.regexp_extract("ref_path", r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    return failure(refs.where((scheme != "") & ~scheme.isin(*allowed)).withColumn("__s", scheme), "WIKI-006", F.concat(F.col("__s"), F.lit(": "), F.col("ref_path")), F.col("line"))


def reference_rules(refs: DataFrame, files: DataFrame) -> DataFrame:
    """Embeds that share their line, and embeds and cross-references to files that aren't there (files: ref_path)."""
    told = refs.join(files.select("ref_path", F.lit(True).alias("__there")).distinct(), "ref_path", "left")
    lost = F.col("__there").isNull()
    wrong = F.array(F.when((F.col("kind") == "embed") & ~F.col("standalone"), "REF-001"), F.when(lost & (F.col("kind") == "embed"), "REF-002"), F.when(lost & (F.col("kind") == "cross_reference"), "REF-006"))
    return told.select(F.explode(F.array_compact(wrong)).alias("rule_id"), "doc_id", F.col("line").cast("int").alias("line"), F.col("ref_path").alias("message"))


def rule_summary(failures: DataFrame) -> DataFrame:
    return failures.groupBy("rule_id").agg(F.count("*").alias("n_failures"), F.countDistinct("doc_id").alias("n_docs"))


def rule_cube(failures: DataFrame) -> DataFrame:
    """``family, area, n_failures`` of failures (rule_id, path), with totals (null means all): rules by what stands before their number, areas by the first folder."""
    return failures.select(F.regexp_extract("rule_id", r"^([A-Z]+)", 1).alias("family"), F.substring_index("path", "/", 1).alias("area")).cube("family", "area").agg(F.count("*").alias("n_failures"))


def exit_code(failures: DataFrame) -> DataFrame:
    """One row ``exit_code``: 1 if there is a failure, else 0."""
    return failures.limit(1).agg(F.count("*").cast("int").alias("exit_code"))


def scope_filter(failures: DataFrame, scopes: DataFrame, known: DataFrame) -> DataFrame:
    """Rows whose path is a scope or below one; a scope that covers no known path raises ValueError."""
    parts = F.split("path", "/", -1)
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    prefixes = lambda rows: rows.select("path").where("path is not null").distinct().select("path", F.explode(above).alias("__scope"))
    s = scopes.select(F.col("path").alias("__scope")).distinct()
    lost = s.join(prefixes(known), "__scope", "left_anti").limit(5).collect()  # for the message
    if lost:
        raise ValueError(f"unknown paths: {[r[0] for r in lost]}")
    return failures.join(prefixes(failures).join(s, "__scope", "left_semi").select("path"), "path", "left_semi").select(*failures.columns)


def frontmatter_rules(docs: DataFrame, known_cwe: DataFrame) -> DataFrame:
    """FND-001 to FND-008: failures of a finding's frontmatter, all that apply.

    ``docs`` is (doc_id, tier, fields map<string, string>, cwe array<int>, tags array<string>), ``known_cwe`` (cwe_id). A null
    map is an empty one. Only the CWE rule needs a join; the others are one pass over the documents.
    """
    fields = F.coalesce("fields", F.create_map().cast("map<string,string>"))
    value = lambda name: F.try_element_at(fields, F.lit(name))

    def each(rule: str, messages: Column) -> Column:
        return F.transform(messages, lambda m: F.struct(F.lit(rule).alias("rule_id"), m.alias("message")))

    def one(rule: str, wrong: Column, message: Column) -> Column:
        return each(rule, F.when(wrong, F.array(message)).otherwise(F.array().cast("array<string>")))

    required = F.array(*[F.lit(f) for f in REQUIRED_FIELDS])
    vector = cvss_parse(value("cvss"))["error"]
    found = F.concat(
        each("FND-001", F.array_except(F.map_keys(fields), F.array(*[F.lit(f) for f in FINDING_FIELDS]))),
        each("FND-002", F.array_except(required, F.map_keys(fields))),
        one("FND-003", ~value("severity").isin(*SEVERITIES), value("severity")),
        one("FND-004", ~value("finding_type").isin(*FINDING_TYPES), value("finding_type")),
        one("FND-005", value("cvss").isNotNull() & vector.isNotNull(), vector),
        one("FND-007", tags_problem(F.col("tags")).isNotNull(), tags_problem(F.col("tags"))),
        one("FND-008", (F.col("tier") == "library") & (F.length(value("affected_entities")) > 0), F.lit("affected entities on a library finding")),
    )
    plain = docs.select("doc_id", F.inline(found)).select("rule_id", "doc_id", F.lit(None).cast("int").alias("line"), "message")
    cwes = docs.select("doc_id", F.explode("cwe").alias("cwe_id")).join(known_cwe.select("cwe_id").distinct(), "cwe_id", "left_anti")
    return plain.unionByName(failure(cwes, "FND-006", F.concat(F.lit("CWE-"), F.col("cwe_id").cast("string"))))


def index_rules(index: DataFrame) -> DataFrame:
    """``rule_id, path, message``: IDX-004 where a file's kind does not fit its path, IDX-002 where another record's does not.

    ``index`` is (path, kind). Whatever lies under a tree that is never synced fails with IDX-002.
    """
    local_only = F.col("path").rlike("^(findings/inbox|methodology/checklists)(/|$)")
    wanted = expected_kind(F.col("path"))
    rule = F.when(~local_only & F.col("path").rlike("(^|/)(evidence|images)(/|$)"), "IDX-004").otherwise("IDX-002")
    message = F.when(local_only, "local-only tree").otherwise(wanted)
    return index.where(local_only | (wanted != F.col("kind"))).select(rule.alias("rule_id"), "path", message.alias("message"))


def unindexed_reports(paths: DataFrame, index: DataFrame) -> DataFrame:
    """IDX-003: the files under a report's folder that the index does not know, as ``rule_id, path, message`` (the folder)."""
    folder = F.regexp_extract("path", "^(findings/reports/[^/]+)/", 1)
    reports = index.where("kind = 'report'").select(F.col("path").alias("message")).distinct()
    return paths.select(F.lit("IDX-003").alias("rule_id"), "path", folder.alias("message")).where("message <> ''").join(reports, "message", "left_anti").select("rule_id", "path", "message")
