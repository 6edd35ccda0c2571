"""Names, tags, links, HTML and lines as column expressions."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Where Python's splitlines() cuts; CRLF counts once.
LINE_END = "\\r\\n|[\\n\\x0b\\f\\r\\x1c-\\x1e\\x85\\x{2028}\\x{2029}]"
#: Letters that decomposition leaves whole, and what they fold to.
FOLDED = {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ð": "d", "þ": "th", "ł": "l", "ħ": "h", "ı": "i", "ĸ": "k", "ŋ": "n", "ŧ": "t", "ſ": "s"}
#: Extensions that a file set takes.
EXTENSIONS = ["txt", "md", "log", "jpg", "jpeg", "png"]


def _accents() -> tuple[str, str]:
    """Latin letters with one accent and their base letters, from Unicode's own tables."""
    import unicodedata

    pairs = []
    for c in map(chr, range(0xC0, 0x250)):
        base = unicodedata.normalize("NFKD", c)
        if len(base) > 1 and base[0].isascii() and all(unicodedata.combining(x) for x in base[1:]):
            pairs.append((c, base[0].lower()))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def slugify(name: Column, fallback: str = "untitled") -> Column:
    """Lower-case words of a-z and 0-9 joined by hyphens; ``fallback`` where nothing is left.

    Accents of the Latin blocks go; combining marks go; other scripts have no slug of their own.
    """
    old, new = _accents()
    s = F.translate(F.lower(F.trim(name)), old, new)
    for letter, plain in FOLDED.items():
        s = F.regexp_replace(s, letter, plain)
    s = F.regexp_replace(F.regexp_replace(s, r"\p{M}+", ""), r"[^a-z0-9]+", "-")
    s = F.regexp_replace(s, r"^-+|-+$", "")
    return F.when(F.coalesce(s, F.lit("")) == "", fallback).otherwise(s)


def collapse_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def html_escape(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def refs_to_html(refs: Column) -> Column:
    """An array of ``struct(text, url)`` as one list: a link where both are there (or a blank text), else the one that is, linked if it starts with http."""

    def one(r: Column) -> Column:
        plain = html_escape(F.coalesce(r["url"], r["text"], F.lit("")))
        link = lambda label: F.concat(F.lit('<li><a href="'), plain, F.lit('">'), label, F.lit("</a></li>"))
        label = F.when(F.trim(r["text"]) == "", plain).otherwise(html_escape(F.trim(r["text"])))
        return F.when(r["url"].isNotNull() & r["text"].isNotNull(), link(label)).when(plain.startswith("http"), link(plain)).otherwise(F.concat(F.lit("<li>"), plain, F.lit("</li>")))

    return F.when(F.size(refs) > 0, F.concat(F.lit("<ul>"), F.array_join(F.transform(refs, one), ""), F.lit("</ul>"))).otherwise("")


@F.pandas_udf(StringType())
def _decoded(texts: pd.Series) -> pd.Series:
    """Every entity of the HTML standard, by name or number, decoded once."""
    return texts.map(lambda t: None if t is None else html.unescape(t))


def html_to_text(html_text: Column) -> Column:
    """Tags to text: blocks start lines, cells are joined by a bar, entities are decoded once, blank lines go."""
    s = F.regexp_replace(html_text, r"(?i)</t[dh]>\s*<t[dh][^>]*>", " | ")
    s = F.regexp_replace(s, r"(?i)<(?:li|p|br|ul|ol|tr|div)\b[^>]*>", "\n")
    s = F.regexp_replace(F.regexp_replace(s, r"(?s)<!--.*?-->", ""), r"<[^>]*>", "")
    lines = F.filter(F.transform(F.split(_decoded(s), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_join(lines, "\n")


def template_escape(text: Column) -> Column:
    """Each template mark as a quoted expression, so that it is printed and not run."""
    return F.regexp_replace(text, r"(\{\{|\}\}|\{%|%\}|\{#|#\})", "{{ '$1' }}")


def template_unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\{\{ '(\{\{|\}\}|\{%|%\}|\{#|#\})' \}\}", "$1")


def tags_problem(tags: Column) -> Column:
    """What is wrong with an array of tags, or null: an empty one, spaces around one, or one twice in any case."""
    lower = F.transform(tags, lambda t: F.lower(t))
    return (
        F.when(F.exists(tags, lambda t: F.coalesce(F.trim(t), F.lit("")) == ""), "empty tag").when(F.exists(tags, lambda t: t != F.trim(t)), "space around tag")
        .when(F.size(F.array_distinct(lower)) < F.size(lower), "repeated tag")
    )


def mask_term(term: Column) -> Column:
    return F.concat(F.substring(term, 1, 1), F.repeat(F.lit("*"), F.greatest(F.length(term) - 1, F.lit(0))))


def good_segment(segment: Column) -> Column:
    """Whether a path segment is named by the rules; names that start with a dot are exempt."""
    return segment.startswith(".") | segment.rlike(r"^[a-z0-9][a-z0-9._-]*$")


def file_name_problem(name: Column) -> Column:
    """What is wrong with a name in a file set, or null."""
    return (
        F.when(name.contains("/") | name.contains("\\"), "separator").when(name.startswith("."), "leading dot").when(is_sidecar(name), "sidecar name")
        .when(F.octet_length(name) > 255, "too long")
    )


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1))


def extension_problem(name: Column) -> Column:
    """A hint for an extension that isn't taken, or null."""
    e = extension(name)
    return F.when(~e.isin(*EXTENSIONS), F.when(e == "gif", "use png").when(e.isin("html", "htm", "csv"), "use txt").otherwise("not allowed"))


def decode_ref_path(path: Column) -> Column:
    """Percent-decoded, or as it is where that gives no UTF-8; a plus stays a plus."""
    decoded = F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.when(decoded.isNull() | decoded.contains("�"), path).otherwise(decoded)


def gallery_token(url: Column) -> Column:
    """The number before the file name of an image address, else the address."""
    n = F.regexp_extract(url, r"/(\d+)/[^/]+$", 1)
    return F.when(n != "", n).otherwise(url)


def composite_id(report: Column, spec: Column) -> Column:
    return report.cast("long") * 100000 + spec


def composite_parts(number: Column) -> Column:
    return F.struct(F.floor(number / 100000).cast("long").alias("report"), F.pmod(number, F.lit(100000)).cast("long").alias("spec"))


def lines(text: Column) -> Column:
    """The lines of a text, without a last empty one; none for an empty text."""
    cut = lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    return F.get(F.transform(F.array(F.split(text, LINE_END)), cut), F.lit(0))  # the text is cut once


def tier(path: Column) -> Column:
    """library, reports instance or inbox of a finding's path, else null."""
    return F.when(path.startswith("findings/library/"), "library").when(path.startswith("findings/reports/"), "instance").when(path.startswith("findings/inbox/"), "inbox")


def expected_kind(path: Column) -> Column:
    """The kind of record that a path's shape implies, else null; working copies of checklists have none."""
    report, wiki = r"^findings/reports/[^/]+", r"^methodology/library/[^/]+"
    return (
        F.when(path.rlike(r"^findings/library/[^/]+\.md$"), "library_finding").when(path.rlike(report + "$"), "report").when(path.rlike(report + r"/[^/]+\.md$"), "reported_finding")
        .when(path.rlike(report + "/evidence/[^/]+$"), "evidence").when(path.rlike(report + r"/notes/[^/]+\.md$"), "note").when(path.rlike(report + r"/narrative/[^/]+\.md$"), "narrative")
        .when(path.rlike(r"^methodology/library/\.shelves(/|$)"), "shelf").when(path.rlike(wiki + "$"), "book").when(path.rlike(wiki + r"/[^/]+\.md$"), "page").when(path.rlike(wiki + "/[^/]+$"), "chapter")
        .when(path.rlike(wiki + "/images/[^/]+$"), "image").when(path.rlike(wiki + r"/[^/]+/[^/]+\.md$"), "page")
    )


def known_place(path: Column) -> Column:
    """Whether a file may lie there: in the library or inbox of findings, in a report (its own files, whatever is in evidence), in a book, a chapter or a shelf."""
    report, book = r"^findings/reports/[^/]+/", r"^methodology/(?:library|checklists)/[^/]+/"
    return (
        path.rlike(r"^findings/(?:library|inbox)/[^/]+\.md$") | path.rlike(report + r"(?:[^/]+\.md|\.report\.yml)$") | path.rlike(report + "evidence/") | path.rlike(report + r"(?:narrative|notes)/[^/]+\.md$")
        | path.rlike(r"^methodology/library/\.shelves/[^/]+$") | path.rlike(book + r"(?:[^/]+\.md|\.book\.yml)$") | path.rlike(book + "images/") | path.rlike(book + r"[^./][^/]*/(?:[^/]+\.md|\.chapter\.yml)$")
    )


def sidecar_name(path: Column) -> Column:
    """``a/b.md`` to ``a/b.remote.md``; the suffix goes last where there is no extension."""
    return F.when(path.rlike(r"[^/]\.[^./]+$"), F.regexp_replace(path, r"(\.[^./]+)$", ".remote$1")).otherwise(F.concat(path, F.lit(".remote")))


def is_sidecar(path: Column) -> Column:
    return path.rlike(r"\.remote(\.[^./]+)?$")


def stem(name: Column) -> Column:
    """A file name without its last suffix."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")
