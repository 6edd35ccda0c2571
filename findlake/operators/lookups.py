"""Joins and lookups, naming, rollups and matching of records."""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from findlake.functions.text import html_to_text, slugify, stem
from findlake.operators.components import components
from findlake.operators.numbering import numbered, settle, stored


def glossary_join(items: DataFrame, glossary: DataFrame, key: str | list[str], pos: str, defaults: dict[str, object]) -> DataFrame:
    """Items with their glossary entry: of repeated keys the last wins, ``defaults`` (column: value) stand in for misses."""
    columns = list(defaults)
    last = glossary.groupBy(key).agg(F.max_by(F.struct(*columns), pos).alias("__g"))
    joined = items.join(last, key, "left")
    return joined.select(*items.columns, *[F.coalesce(F.col(f"__g.{c}"), F.lit(v)).alias(c) for c, v in defaults.items()])


def resolve_refs(refs: DataFrame, files: DataFrame, on: Sequence[str] = ("folder", "filename")) -> DataFrame:
    """``refs`` with ``resolved``; files are brought down to their keys first."""
    known = files.select(*on).distinct().withColumn("resolved", F.lit(True))
    return refs.join(known, list(on), "left").withColumn("resolved", F.coalesce("resolved", F.lit(False)))


def resolve_ref_ids(refs: DataFrame, index: DataFrame, names: DataFrame, reports: str = "findings/reports/") -> DataFrame:
    """``id`` of each reference (report, path, name): that of its path, else of the first row (by ``seq``) of that name.

    ``index`` is (path, id), paths from the top; a reference's path is relative to its report's folder, which is ``reports`` and the
    report. ``names`` is (report, name, seq, id). A reference stays inside its own report: an id whose indexed path lies elsewhere,
    or that isn't indexed, is none.
    """
    home = lambda report: F.concat(F.lit(reports), F.col(report).cast("string"), F.lit("/"))
    by_path = index.groupBy(F.col("path").alias("__path")).agg(F.min("id").alias("__by_path"))
    first = names.groupBy("report", "name").agg(F.min_by("id", "seq").alias("__by_name"))
    where = index.groupBy(F.col("id").alias("__by_name")).agg(F.min("path").alias("__home"))
    inside = first.join(where, "__by_name").where(F.col("__home").startswith(home("report"))).drop("__home")
    joined = refs.join(by_path, F.concat(home("report"), "path") == F.col("__path"), "left").join(inside, ["report", "name"], "left")
    return joined.select(*refs.columns, F.coalesce("__by_path", "__by_name").alias("id"))


def internal_link_check(links: DataFrame, namespace: DataFrame, host: str | None) -> DataFrame:
    """Links (doc_id, url) to a page or chapter that isn't in ``namespace`` (book, kind, slug; kind is page or chapter).

    Internal are paths that start with /books/, and http and https addresses of ``host``, whose path is a book, a kind and a slug and no
    more (a last slash, a query and a fragment of an address don't count). Slugs are looked up in lower case, books as they are.
    """
    path = r"^/books/([^/]+)/(page|chapter)/([^/]+)/?$"
    address = r"^https?://([^/?#]*)([^?#]*)"
    own = F.when(F.col("url").rlike("^https?://"), F.when(F.regexp_extract("url", address, 1) == F.lit(host), F.regexp_extract("url", address, 2))).when(F.col("url").startswith("/books/"), F.col("url"))
    wanted = links.withColumn("__path", own).where(F.col("__path").rlike(path))
    wanted = wanted.withColumns({"book": F.regexp_extract("__path", path, 1), "kind": F.regexp_extract("__path", path, 2), "slug": F.lower(F.regexp_extract("__path", path, 3))}).drop("__path")
    return wanted.join(namespace.select("book", "kind", "slug").distinct(), ["book", "kind", "slug"], "left_anti")


def book_members(pages: DataFrame, chapters: DataFrame) -> DataFrame:
    """``page_id, book_id``: a page's own book, or its chapter's."""
    c = chapters.select(F.col("id").alias("chapter_id"), F.col("book_id").alias("__book"))
    return pages.join(c, "chapter_id", "left").select("page_id", F.coalesce("book_id", "__book").alias("book_id")).where("book_id is not null")


def recycled_awareness(indexed: DataFrame, live: DataFrame, bin_: DataFrame) -> DataFrame:
    """Indexed ids that aren't live: recoverable (in the bin) or gone."""
    binned = bin_.select("id").distinct().withColumn("__bin", F.lit(True))
    return indexed.join(live.select("id").distinct(), "id", "left_anti").join(binned, "id", "left").select("id", F.when(F.col("__bin"), "recoverable").otherwise("gone").alias("state"))


def scope_tripwire(projects: DataFrame, reports: DataFrame, scopes: DataFrame, key: str = "project_id") -> DataFrame:
    """Projects with a report and no scope."""
    return projects.join(reports.select(key).distinct(), key, "left_semi").join(scopes.select(key).distinct(), key, "left_anti")


def _swap_images(docs: DataFrame, pattern: str, inner: str, names: DataFrame, new: Column, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with the target of each image that ``pattern`` finds put as ``new`` where ``names`` (target, value) has it.

    Only targets are exploded and shuffled, and come back by id; ids are those of one document each. Texts that are null stay so.
    """
    found = docs.select(id_col, F.posexplode(F.regexp_extract_all(text_col, F.lit(pattern), 0)).alias("k", "m")).withColumn("target", F.regexp_extract("m", inner, 1))
    told = found.join(names, "target", "left").join(docs.drop(text_col), id_col)
    kept = F.concat(F.regexp_extract("m", r"^(!\[[^\]]*\]\()", 1), new, F.regexp_extract("m", r"((?:\s+\"[^\"]*\")?\))$", 1))
    each = told.select(id_col, F.struct("k", F.coalesce(kept, F.col("m")).alias("t")).alias("x"))
    tokens = each.groupBy(id_col).agg(F.array_sort(F.collect_list("x"))["t"].alias("__t"))
    joined = F.array_join(F.zip_with(F.split(text_col, pattern), "__t", lambda gap, t: F.concat(gap, F.coalesce(t, F.lit("")))), "")
    return docs.join(tokens, id_col, "left").withColumn(text_col, F.when(F.col("__t").isNull(), F.col(text_col)).otherwise(joined)).select(*docs.columns)


def translate_urls(docs: DataFrame, gallery: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every image in ``images/`` or ``../images/`` that the gallery (name, url) knows put as its address; others, and paths that aren't images, stay."""
    known = gallery.groupBy(F.col("name").alias("target")).agg(F.min("url").alias("value"))
    return _swap_images(docs, r"!\[[^\]]*\]\((?:\.\./)?images/[^)\s\"]+(?:\s+\"[^\"]*\")?\)", r"\]\((?:\.\./)?images/([^)\s\"]+)", known, F.col("value"), id_col, text_col)


def localise_urls(docs: DataFrame, gallery: DataFrame, in_chapter: str = "in_chapter", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The way back: images at an address of the gallery as files in ``images/``, or ``../images/`` for documents ``in_chapter``."""
    known = gallery.groupBy(F.col("url").alias("target")).agg(F.min("name").alias("value"))
    path = F.concat(F.when(F.col(in_chapter), "../images/").otherwise("images/"), F.col("value"))
    return _swap_images(docs, r"!\[[^\]]*\]\(https?://[^)\s\"]+(?:\s+\"[^\"]*\")?\)", r"\]\((https?://[^)\s\"]+)", known, path, id_col, text_col)


# Naming


def file_stems(df: DataFrame, title: str = "title", key: str = "key", content: str = "content") -> DataFrame:
    """``stem``: the title's slug; where several share it with the key's slug, or a content hash where there is no key; where that is shared too, with a content hash.

    How often a slug occurs is counted first and joined, so that one common slug is no hot spot.
    """
    digest = F.substring(F.sha2(F.col(content).cast("string"), 256), 1, 8)

    def shared(rows: DataFrame, column: str) -> DataFrame:
        often = rows.groupBy(column).count().where("count > 1").select(column, F.lit(True).alias("__often"))
        return rows.join(often, column, "left")

    named = F.coalesce(F.col(key).cast("string"), F.lit("")) != ""
    rows = shared(df.withColumn("__slug", slugify(F.col(title))), "__slug")
    rows = rows.withColumn("__stem", F.when(F.col("__often"), F.concat_ws("-", "__slug", F.when(named, slugify(F.col(key))).otherwise(digest))).otherwise(F.col("__slug"))).drop("__often")
    rows = shared(rows, "__stem")
    return rows.select(*df.columns, F.when(F.col("__often"), F.concat_ws("-", "__stem", digest)).otherwise(F.col("__stem")).alias("stem"))


def dedupe_names(df: DataFrame, folder: str = "folder", name: str = "name", order: str = "id") -> DataFrame:
    """``unique_name``: in order of id ``n``, ``n-2``, ``n-3``..., for folders where no name itself ends in such a number."""
    k = F.col("__k")
    return numbered(df, [folder, name], [order], "__k").withColumn("unique_name", F.when(k == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit("-"), k.cast("string")))).drop("__k")


NUMBERED_NAME = r"^(?s:(.*))-([1-9][0-9]{0,8})$"


def dedupe_names_exact(df: DataFrame, folder: str = "folder", name: str = "name", order: str = "id") -> DataFrame:
    """As ``dedupe_names``, also where names look like numbered ones: in order of id each name gets the first free of ``n``, ``n-2``, ``n-3``...

    A number of a name is taken by its own rows, one after the other, or by a row that is called so. The numbers of a name that others
    take before its own rows reach them are told by one pass over them in order of number, which keeps two counters; rows then get
    their place among the name's rows plus the taken numbers in front of it. Places and sums come from ranges of folder, name
    and id, so that a name of any number of rows lies in many tasks. A name's own first number can be taken by the name without its
    ending, so names are settled by how many endings they have, a round each. Ids are unique in a folder.
    """
    group = ["__dir", "__base"]
    rows = df.withColumn("__dir", F.coalesce(F.concat(F.lit("="), F.col(folder).cast("string")), F.lit("-"))).withColumn("__base", F.col(name)).withColumn("__id", F.col(order))
    rows = numbered(rows, group, ["__id"], "__place")
    first = rows.groupBy(*group).agg(F.min("__id").alias("__first"), F.count("*").alias("__size"))
    # names with a number that another name in the folder can come to
    claims = first.where(F.col("__base").rlike(NUMBERED_NAME)).select("__dir", F.regexp_extract("__base", NUMBERED_NAME, 1).alias("__base"), F.regexp_extract("__base", NUMBERED_NAME, 2).cast("long").alias("__number"), "__first").where("__number >= 2")
    claims = claims.join(first.select(*group, "__size"), group)
    # of each claim how many of the name's own rows come before it
    events = rows.select(*group, "__id", F.lit(1).alias("__own"), F.lit(None).cast("long").alias("__number"), F.lit(None).cast("long").alias("__size"))
    events = events.unionByName(claims.select(*group, F.col("__first").alias("__id"), F.lit(0).alias("__own"), "__number", "__size"))
    endings = F.size(F.split(F.regexp_extract("__base", r"((?:-[1-9][0-9]{0,8})*)$", 1), "-")) - 1
    asked = ["__dir", "__base", "__number", "__size", "__reach"]
    told = settle(numbered(events, group, ["__id", "__own"], "__reach", amount="__own").where("__own = 0").select(*asked, endings.alias("__depth")))
    deepest = told.agg(F.max("__depth")).first()[0]

    def pass_over(batches):
        key, skipped = None, 0
        for batch in batches:
            found = []
            for f, n, number, size, before in zip(*(batch[c].tolist() for c in asked), strict=True):
                if (f, n) != key:
                    key, skipped = (f, n), 0
                at = number - skipped  # the own row that comes to this number
                if at <= size:
                    found.append((f, n, number, at, at > before))
                    skipped += at > before
            yield pd.DataFrame(found, columns=["__dir", "__base", "__number", "__came", "__lost"])

    schema = "__dir string, __base string, __number long, __came long, __lost boolean"
    # names that have lost their own first number to the name without their ending
    lost = told.select(*asked).where("false")
    skips = None
    for depth in range(-1 if deepest is None else deepest + 2):
        claimed = told.where(F.col("__depth") == depth).select(*asked).unionByName(lost)
        found = settle(claimed.repartition(*group).sortWithinPartitions(*group, "__number").mapInPandas(pass_over, schema))
        own = found.where("__lost").select(*group, F.col("__came").alias("__place"))
        skips = own if skips is None else skips.unionByName(own)
        taken = found.where("not __lost and __number > 1").select("__dir", F.concat_ws("-", "__base", F.col("__number").cast("string")).alias("__base"))
        lost = settle(taken.join(first, group).select(*group, F.lit(1).cast("long").alias("__number"), "__size", F.lit(0).cast("long").alias("__reach")))
    number = F.col("__place")
    if skips is not None:
        both = rows.withColumn("__skip", F.lit(0)).unionByName(skips.withColumn("__skip", F.lit(1)), allowMissingColumns=True)
        rows = numbered(both, group, ["__place", F.desc("__skip")], "__skips", amount="__skip").where("__skip = 0")
        number = F.col("__place") + F.col("__skips")
    return rows.withColumn("unique_name", F.when(number == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit("-"), number.cast("string")))).select(*df.columns, "unique_name")


def keep_newest(runs: DataFrame, n: int = 10, order: str = "run_id") -> DataFrame:
    """Rows of the newest ``n`` runs: only the ids of runs are ranked."""
    newest = runs.select(order).distinct().orderBy(F.desc(order)).limit(n)
    return runs.join(newest, order, "left_semi")


# Rollups


def kind_summary(plan: DataFrame, outcomes: Sequence[str]) -> DataFrame:
    return plan.groupBy("kind").pivot("outcome", list(outcomes)).count().na.fill(0)


def problem_paths(plan: DataFrame, outcomes: Sequence[str] = ("COLLISION", "INVALID", "WITHHELD")) -> DataFrame:
    """``kind, outcome, path`` of what a summary names: the paths of the outcomes that are problems, a row each, not gathered."""
    return plan.where(F.col("outcome").isin(*outcomes)).select("kind", "outcome", "path")


def status_counts(status: DataFrame, kinds: DataFrame, buckets: Sequence[str]) -> DataFrame:
    """``kind, status, n`` with zeros: every bucket of every kind."""
    grid = kinds.select("kind").distinct().select("kind", F.explode(F.array(*[F.lit(b) for b in buckets])).alias("status"))
    return grid.join(status.groupBy("kind", "status").agg(F.count("*").alias("n")), ["kind", "status"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def caption_opinions(refs: DataFrame, longest: int = 255) -> DataFrame:
    """Per file (folder, name): the one non-empty caption, or conflict, or too long; ``n_captions`` different ones."""
    each = refs.where(F.coalesce(F.col("caption"), F.lit("")) != "").groupBy("folder", "name", "caption").agg(F.min("pos").alias("pos"))
    n = each.groupBy("folder", "name").agg(F.count("*").alias("n_captions"), F.min_by("caption", "pos").alias("caption"))
    problem = F.when(F.col("n_captions") > 1, "conflict").when(F.length("caption") > longest, "too long")
    return n.select("folder", "name", F.when(F.col("n_captions") == 1, F.col("caption")).alias("caption"), "n_captions", problem.alias("problem"))


def caption_rules(embeds: DataFrame, longest: int = 255) -> DataFrame:
    """``rule_id, doc_id, line, message`` of embeds (report, path, caption, doc_id, line): REF-010 and REF-004, each at every embed.

    A caption over ``longest`` characters is wrong by itself; where the captions of a report's file that aren't blank differ, every
    embed of that file is. Captions are brought down to different ones before they are counted.
    """
    rows = embeds.withColumn("__c", F.when(F.trim("caption") != "", F.col("caption")))
    differ = rows.groupBy("report", "path", "__c").count().groupBy("report", "path").agg(F.count("__c").alias("__n")).where("__n > 1")
    long = embeds.where(F.length("caption") > longest).select(F.lit("REF-010").alias("rule_id"), "doc_id", F.col("line").cast("int").alias("line"), F.concat("path", F.lit(": "), F.length("caption").cast("string"), F.lit(" characters")).alias("message"))
    wrong = embeds.join(differ, ["report", "path"]).select(F.lit("REF-004").alias("rule_id"), "doc_id", F.col("line").cast("int").alias("line"), F.concat("path", F.lit(": "), F.col("__n").cast("string"), F.lit(" captions")).alias("message"))
    return long.unionByName(wrong)


def stem_groups(files: DataFrame) -> DataFrame:
    """Files (folder, name) that share a stem with another in their folder, sidecars left out."""
    plain = files.where(~F.col("name").rlike(r"\.remote(\.[^./]+)?$")).withColumn("stem", stem(F.col("name")))
    often = plain.groupBy("folder", "stem").agg(F.count("*").alias("n")).where("n > 1")
    return plain.join(often, ["folder", "stem"])


def index_uniqueness(index: DataFrame) -> DataFrame:
    """``kind, id, n_paths`` of identities under more than one path."""
    return index.groupBy("kind", "id").agg(F.countDistinct("path").alias("n_paths")).where("n_paths > 1")


def index_problems(index: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """``rule_id, path, message``: IDX-001 of index entries (path, kind, id as text), all that apply.

    A path must be relative, of forward slashes, without ``..`` and not empty; a kind one of ``kinds``; an id an integer; and no kind and id
    may be under two paths (each of them has a row).
    """
    path = F.coalesce("path", F.lit(""))
    each = F.array_compact(F.array(
        F.when(path == "", "empty path"), F.when(path.contains("\\"), "backslash"), F.when(path.startswith("/"), "absolute path"), F.when(F.array_contains(F.split(path, "/"), ".."), "parent segment"),
        F.when(~F.coalesce(F.col("kind").isin(*kinds), F.lit(False)), "unknown kind"), F.when(~F.coalesce(F.col("id").rlike(r"^-?(?:0|[1-9][0-9]*)$"), F.lit(False)), "no integer id"),
    ))
    alone = index.select("path", F.explode(each).alias("message"))
    twice = index.groupBy("kind", "id").agg(F.count_distinct("path").alias("__n")).where("__n > 1 and id is not null and kind is not null")
    shared = index.join(twice, ["kind", "id"]).select("path", F.concat_ws(" ", F.lit("identity"), "kind", "id", F.lit("twice")).alias("message"))
    return alone.unionByName(shared).select(F.lit("IDX-001").alias("rule_id"), "path", "message")


def primary_home(reports: DataFrame) -> DataFrame:
    """``project_id, directory``: that of the lowest report that has one."""
    return reports.where("directory is not null").groupBy("project_id").agg(F.min_by("directory", "report_id").alias("directory"))


def end_of_band_position(new: DataFrame, existing: DataFrame, order: str) -> DataFrame:
    """``position`` of new rows of each (report, severity): after the highest there is, in order."""
    band = ["report", "severity"]
    top = existing.groupBy(*band).agg(F.max("position").alias("__top"))
    placed = numbered(new, band, [order], "__k").join(top, band, "left")
    return placed.withColumn("position", F.coalesce(F.col("__top") + 1, F.lit(0)) + F.col("__k") - 1).drop("__top", "__k")


def ordered_members(rows: DataFrame, group: str, order: Sequence[str], value: str, out: str) -> DataFrame:
    """The values of each group in order, joined by commas."""
    items = F.array_sort(F.collect_list(F.struct(*[F.col(c).isNull() for c in order], *order, F.col(value).alias("__v"))))
    return rows.groupBy(group).agg(F.array_join(F.transform(items, lambda s: s["__v"].cast("string")), ",").alias(out))


# Matching


def identical_pairs(old: DataFrame, new: DataFrame) -> DataFrame:
    """One-to-one ``old_path, new_path`` of equal hashes, both in order of path: what a greedy match gives where all edges are equal."""
    a = numbered(old.where("hash is not null").select("hash", F.col("path").alias("old_path")), ["hash"], ["old_path"], "k")
    b = numbered(new.where("hash is not null").select("hash", F.col("path").alias("new_path")), ["hash"], ["new_path"], "k")
    return a.join(b, ["hash", "k"]).select("old_path", "new_path")


#: Texts of one side and block that meet in one task, twice as many where they have ``LONG`` letters on the whole; more are split.
PAIR_ROWS = 500
#: Letters of one side and block that meet in one task; more are split.
PAIR_LETTERS = 2_000_000
#: Lengths of the pieces of text whose counts bound a similarity: of short texts, and of those of some ``LONG`` letters and more.
PIECES = (6, 8)
LONG = 800
#: Of the pieces that a pair must have in common this share is looked for among the most frequent ones only in pairs that the others leave.
LATE = 0.8
#: Places of an index that the pairs which need least decide: a tenth of them.
LEAST = 10


def _pieces(text: np.ndarray, q: int) -> np.ndarray:
    """A hash of each piece of ``q`` letters; equal pieces have equal hashes."""
    if q == 1:
        return text.astype(np.uint64)
    short, n = q // 2, max(0, len(text) - q + 1)
    left = _pieces(text, q - short)
    right = left if 2 * short == q else _pieces(text, short)
    return left[:n] * np.uint64(pow(1_000_003, short, 1 << 64)) + right[q - short : q - short + n]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _once(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values in order, and how often each occurs."""
    values = np.sort(values)
    first = np.ones(len(values) + 1, bool)
    np.not_equal(values[1:], values[:-1], out=first[1:-1])
    at = np.flatnonzero(first) if len(values) else np.zeros(1, np.int64)
    return values[at[:-1]], at[1:] - at[:-1]


def _hopeful(olds: list[str], news: list[str], threshold: float) -> Iterator[tuple[int, int]]:
    """Places (old, new) of the pairs whose matching-blocks ratio, new against old, may reach ``threshold``, an old text after the other."""
    for q, some in zip(PIECES, ([i for i, t in enumerate(olds) if len(t) < LONG], [i for i, t in enumerate(olds) if len(t) >= LONG]), strict=True):
        if some:
            least, most = (f(len(olds[i]) for i in some) for f in (min, max))
            near = [j for j, t in enumerate(news) if least * threshold / (2 - threshold) - 1 <= len(t) <= most * (2 - threshold) / threshold + 1]
            for i, j in _hopeful_by_pieces([olds[i] for i in some], [news[j] for j in near], threshold, q) if near else ():
                yield some[i], near[j]


def _hopeful_by_pieces(olds: list[str], news: list[str], threshold: float, q: int) -> Iterator[tuple[int, int]]:
    """``_hopeful`` by pieces of ``q`` letters.

    The matching letters are no more than the letters in common. A block that matches holds a letter that is no popular one of the
    old text (of 200 letters or more: one that makes up a hundredth), but for one at the very front; so there are no more blocks
    than such letters in common, and one. A block of n letters has n - q + 1 pieces of q, so the matching letters are no more than the old
    text's pieces that are in the new one, and q - 1 a block. Pieces go by some bits of a hash, which can only add to those in common.
    An index over the new texts counts them. The most frequent pieces, fewer than a pair needs, are counted only where the others leave a pair.
    """
    by_size = sorted(range(len(news)), key=lambda j: len(news[j]))
    codes = [_codes(news[j]) for j in by_size]
    sizes = np.array([len(c) for c in codes])
    letters = sorted(map(ord, set().union(*map(set, olds), *map(set, news))))
    rank = np.zeros(max(letters, default=0) + 1, np.int32)
    rank[letters] = np.arange(len(letters))
    counted = lambda c: np.bincount(rank[c], minlength=len(letters)).astype(np.int32)
    have = np.ascontiguousarray(np.array([counted(c) for c in codes]).T)
    bits = min(24, max(10, int(sizes.sum()).bit_length()))
    hashed = lambda c: (_pieces(c, q) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int32)
    own = [_once(hashed(c))[0] for c in codes]
    flat = np.concatenate(own)
    at = np.sort(flat.astype(np.int64) << 32 | np.repeat(np.arange(len(own)), [len(o) for o in own])).astype(np.int32)  # the lower half
    starts = np.concatenate([np.zeros(1, np.int32), np.cumsum(np.bincount(flat, minlength=1 << bits), dtype=np.int32)])
    for i, t in enumerate(olds):
        n = len(t)
        low, high = np.searchsorted(sizes, n * threshold / (2 - threshold) - 1), np.searchsorted(sizes, n * (2 - threshold) / threshold + 1, "right")
        if low == high:
            continue
        code = _codes(t)
        counts = counted(code)
        there = np.flatnonzero(counts)
        common = np.minimum(have[there, low:high], counts[there, None])
        least = threshold * (sizes[low:high] + n) / 2 - 1e-6
        open_ = (np.minimum(sizes[low:high], n) >= least) & (common.sum(0) >= least)
        blocks = common[counts[there] <= n // 100 + 1 if n >= 200 else slice(None)].sum(0) + 1
        need = least - (q - 1) * blocks
        if not open_.any():
            continue
        pieces, times = _once(hashed(code))
        begin = starts[pieces]
        long = starts[pieces + 1] - begin
        known = np.flatnonzero(long)
        pieces, times, begin, long = pieces[known], times[known], begin[known], long[known]
        live = np.flatnonzero(open_ & (need <= times.sum()))
        if not len(live):
            continue

        def count(which: np.ndarray, begin=begin, long=long, times=times, low=low, high=high) -> np.ndarray:
            many = long[which]
            spots = np.arange(many.sum()) + np.repeat(begin[which] - np.cumsum(many) + many, many)
            return np.bincount(at[spots], weights=np.repeat(times[which], many), minlength=len(own))[low:high]

        few = len(live) // LEAST
        order = np.argsort(-long, kind="stable")
        cut = np.searchsorted(np.cumsum(times[order]), LATE * np.partition(need[live], few)[few], "right")
        late = order[:cut]
        found = count(order[cut:])
        live = live[found[live] + times[late].sum() >= need[live]]
        if long[late].sum() < 2000 * len(live):
            found += count(late)
            live = live[found[live] >= need[live]]
            late = late[:0]
        for j in live.tolist():
            if len(late) and found[j] < need[j]:
                mine = own[low + j]
                place = np.minimum(np.searchsorted(mine, pieces[late]), len(mine) - 1)
                if not len(mine) or found[j] + times[late][mine[place] == pieces[late]].sum() < need[j]:
                    continue
            yield i, by_size[low + j]


class _Blocks:
    """The matching-blocks ratio of texts against an old one, as ``SequenceMatcher(None, new, old).ratio()`` gives it, without its walk over all pairs of equal letters.

    What matches best between two stretches is the longest run of letters that are no popular ones of the old text, of such runs the first in the new
    text, at its first place in the old one; it is extended by whatever is equal beside it. So places of runs of each length are written down once. The runs of
    a stretch that are as long as its longest are taken from the left, each left of the one before in neither text, and what lies between them has shorter ones only.
    """

    def __init__(self, old: str):
        self.old = old
        most = len(old) // 100 + 1 if len(old) >= 200 else len(old)
        rare = "".join(re.escape(c) for c in set(old) if old.count(c) <= most)
        self.places: dict[int, dict[str, list[int]]] = {1: {}}
        self.rare, self.runs = None, []
        if rare:
            self.rare = re.compile(f"[{rare}]")
            for m in self.rare.finditer(old):
                self.places[1].setdefault(m[0], []).append(m.start())
            self.runs = [m.span() for m in re.finditer(f"[{rare}]+", old)]

    def _of_length(self, n: int) -> dict[str, list[int]]:
        if n not in self.places:
            found = self.places[n] = {}
            for begin, end in self.runs:
                for i in range(begin, end - n + 1):
                    found.setdefault(self.old[i : i + n], []).append(i)
        return self.places[n]

    def ratio(self, new: str, least: float = 0.0) -> float:
        """The ratio, or 0 as soon as it can't reach ``least``."""
        old = self.old
        if not new and not old:
            return 1.0
        letters = [m.start() for m in self.rare.finditer(new)] if self.rare else []
        met = {1: (letters, [self.places[1][new[i]] for i in letters])}

        def first(n: int, alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int] | None:
            """The first run of ``n`` letters of the new text's stretch that is in the old one's, and its first place there."""
            if n not in met:
                known = self._of_length(n)
                at = [i for i in met[max(k for k in met if k < n)][0] if new[i : i + n] in known]
                met[n] = at, [known[new[i : i + n]] for i in at]
            at, places = met[n]
            for x in range(bisect_left(at, alo), bisect_right(at, ahi - n)):
                p = places[x]
                y = bisect_left(p, blo)
                if y < len(p) and p[y] + n <= bhi:
                    return at[x], p[y]
            return None

        needed = least * (len(new) + len(old)) / 2 - 1e-6
        matched, possible = 0, min(len(new), len(old))
        todo = [(0, len(new), 0, len(old), possible)]
        while todo:
            alo, ahi, blo, bhi, most = todo.pop()
            shorter = min(ahi - alo, bhi - blo)
            size, best, over = 0, None, min(most, shorter) + 1
            n = 1 if over > 4 else over - 1
            while size + 1 < over:  # few lengths are tried from above; many are doubled, then halved between one that is there and one that isn't
                if got := first(n, alo, ahi, blo, bhi):
                    size, best = n, got
                    n = 2 * n if 2 * n < over else (n + over) // 2
                else:
                    over = n
                    n = (size + over) // 2 if over > 4 or size else over - 1
            i, j = best or (alo, blo)
            e, f = i + size, j + size
            while size and i > alo and j > blo and new[i - 1] == old[j - 1]:
                i, j = i - 1, j - 1
            while e + 32 <= ahi and f + 32 <= bhi and new[e : e + 32] == old[f : f + 32]:
                e, f = e + 32, f + 32
            while e < ahi and f < bhi and new[e] == old[f]:
                e, f = e + 1, f + 1
            matched += e - i
            possible += e - i - shorter
            if size and alo < i and blo < j:
                todo.append((alo, i, blo, j, size - 1))
                possible += min(i - alo, j - blo)
            if size and e < ahi and f < bhi:
                todo.append((e, ahi, f, bhi, size))
                possible += min(ahi - e, bhi - f)
            if possible < needed:
                return 0.0
        return 2.0 * matched / (len(new) + len(old))


def _collapsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """White space of ``text`` collapsed, as ``str.split`` sees it."""
    for batch in batches:
        texts = pa.array([" ".join(t.split()) for t in batch["text"].to_pylist()], batch["text"].type)
        yield batch.set_column(batch.schema.get_field_index("text"), batch.schema.field("text"), texts)


def similar_pairs(old: DataFrame, new: DataFrame, threshold: float = 0.6) -> DataFrame:
    """``old_path, new_path, score`` of texts whose matching-blocks ratio reaches ``threshold``, within a block.

    Both sides have block, path, text. The ratio is that of the new text against the old one, white space collapsed; it is not
    symmetric. It is at most 2 * shared letters / (sum of lengths). So in large blocks lengths are cut into ranges of that ratio, and a text meets
    its own range and the next ones. Both sides of a range with many texts are split, and each part of one meets each of the other in a task that holds
    no more than the two; small blocks share tasks. There pairs are ruled out by counts of letters and of short pieces, and only the others are
    compared; copies are compared once. Nothing that reaches the threshold is lost. The work of a block still grows with its pairs, of which
    most cost some counts.
    """
    step = math.log(2 / threshold - 1)
    grid_keys, columns = ["lot", "part", "old_part"], ["block", "cell", "path", "text"]
    around = F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1))

    def side(df: DataFrame, tag: str) -> DataFrame:
        rows = df.where("block is not null and text is not null").select("block", "path", F.col("text").cast("string").alias("text"))
        rows = rows.mapInArrow(_collapsed, rows.schema).withColumn("letters", F.length("text"))
        return stored(rows.withColumn("cell", F.floor(F.log(F.greatest(F.col("letters"), F.lit(1))) / step)), tag)

    def sizes(rows: DataFrame) -> DataFrame:
        return rows.groupBy("block", "cell").agg(F.count("*").alias("n"), F.sum("letters").alias("letters"))

    def parts(counts: DataFrame, name: str) -> DataFrame:
        rows = F.when(F.sum("letters") < LONG * F.sum("n"), PAIR_ROWS).otherwise(2 * PAIR_ROWS)
        most = F.greatest(F.sum("n") / rows, F.sum("letters") / PAIR_LETTERS)
        return counts.groupBy("block", "cell").agg(F.ceil(most).cast("int").alias(name))

    b, a = side(new, "new"), side(old, "old")
    counts_b, counts_a = sizes(b), sizes(a)
    whole = counts_b.withColumn("side", F.lit(1)).unionByName(counts_a.withColumn("side", F.lit(0))).groupBy("block", "side").agg(F.sum("n").alias("n"), F.sum("letters").alias("letters"))
    whole = stored(whole.groupBy("block").agg(F.max("n").alias("n"), F.max("letters").alias("most"), F.sum("letters").alias("letters"), F.count("*").alias("sides")).where("sides = 2"), "blocks")
    is_large = (F.col("n") > PAIR_ROWS) | (F.col("most") > PAIR_LETTERS)
    large, small = whole.where(is_large).select("block"), whole.where(~is_large)
    lots = (small.agg(F.sum("letters")).first()[0] or 0) // PAIR_LETTERS + 1
    # of large blocks there are no more than texts / PAIR_ROWS and letters / PAIR_LETTERS
    grid = F.broadcast(parts(counts_b.join(F.broadcast(large), "block"), "news").join(parts(counts_a.join(F.broadcast(large), "block").withColumn("cell", around), "olds"), ["block", "cell"]))

    def dealt(rows: DataFrame, each: DataFrame, mine: str, mine_of: str, other: str, other_of: str) -> DataFrame:
        split = each.join(grid, ["block", "cell"]).withColumn(mine, F.pmod(F.xxhash64("path"), F.col(mine_of)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other_of) - 1)))
        split = split.select(F.xxhash64("block", "cell").alias("lot"), "part", "old_part", *columns)
        together = rows.join(F.broadcast(large), "block", "left_anti").select(F.pmod(F.xxhash64("block"), F.lit(lots)).alias("lot"), F.lit(0).alias("part"), F.lit(0).alias("old_part"), "block", F.lit(0).cast("long").alias("cell"), "path", "text")
        return split.unionByName(together).select(*[F.col(c).alias(c) for c in [*grid_keys, *columns]])  # columns of their own, since each side has met the other's counts

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        held: list[dict] = []
        for table in (left, right):
            by_text: dict[tuple, dict[str, list[int]]] = {}
            for i, (block, cell, t) in enumerate(zip(*(table[c].to_pylist() for c in ("block", "cell", "text")), strict=True)):
                by_text.setdefault((block, cell), {}).setdefault(t, []).append(i)
            held.append(by_text)
        at, to, scores = [], [], []
        for key in held[0].keys() & held[1].keys():
            (olds, old_rows), (news, new_rows) = [(list(h[key]), list(h[key].values())) for h in held]
            last, blocks = -1, None
            for i, j in _hopeful(olds, news, threshold):
                if i != last:
                    last, blocks = i, _Blocks(olds[i])
                score = 1.0 if olds[i] == news[j] else blocks.ratio(news[j], threshold)
                if score >= threshold:
                    for x in old_rows[i]:
                        at += [x] * len(new_rows[j])
                        to += new_rows[j]
                    scores += [score] * (len(old_rows[i]) * len(new_rows[j]))
        return pa.table({"old_path": left["path"].take(pa.array(at, pa.int64())), "new_path": right["path"].take(pa.array(to, pa.int64())), "score": pa.array(scores, pa.float64())})

    schema = T.StructType([T.StructField("old_path", old.schema["path"].dataType), T.StructField("new_path", new.schema["path"].dataType), T.StructField("score", T.DoubleType())])
    lefts = dealt(a, a.withColumn("cell", around), "old_part", "olds", "part", "news")
    rights = dealt(b, b, "part", "news", "old_part", "olds")
    return lefts.groupBy(*grid_keys).cogroup(rights.groupBy(*grid_keys)).applyInArrow(compare, schema)


def identical_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """``old_path, new_path, score, edited`` of one-to-one pairs of equal hashes, as edges of score 1 for ``greedy_match``.

    Among edges of one hash, which are all equal, a greedy match takes them in order of path on both sides.
    """
    return identical_pairs(old, new).select("old_path", "new_path", F.lit(1.0).alias("score"), F.lit(False).alias("edited"))


def similar_edges(pairs: DataFrame) -> DataFrame:
    """Pairs of ``similar_pairs`` as edges for ``greedy_match``: a match by them is an edited one."""
    return pairs.select("old_path", "new_path", "score", F.lit(True).alias("edited"))


def greedy_match(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """One-to-one pairs of ``edges`` (old_path, new_path, score and more columns): best score first, ties by old then new path.

    Edges that are the best of both their ends are taken, round by round, and their ends leave. What is left after ``rounds`` is
    parted in connected components, which don't touch each other: the edges of each are gone through in order, a component after
    the other in its task, with no more in memory than a component's ends that are taken. So scores that rise along a path, of which a
    round settles one edge, end in one pass.
    """
    order = [F.desc("score"), F.col("old_path"), F.col("new_path")]
    best = F.struct(-F.col("score"), F.col("old_path"), F.col("new_path"))

    taken, left = None, stored(edges, "edges")
    for _ in range(rounds):
        # the first edge of each end comes from one aggregate a side, partial before the shuffle
        by_old = left.groupBy("old_path").agg(F.min(best).alias("a")).select(F.col("old_path").alias("__o"), F.col("a.new_path").alias("__n"))
        by_new = left.groupBy("new_path").agg(F.min(best).alias("b")).select(F.col("b.old_path").alias("__o"), F.col("new_path").alias("__n"))
        both = by_old.join(by_new, ["__o", "__n"])
        sure = stored(left.join(both, (F.col("old_path") == F.col("__o")) & (F.col("new_path") == F.col("__n"))).drop("__o", "__n").groupBy("old_path", "new_path").agg(*_first_of(edges)).select(*edges.columns), "taken")
        taken = sure if taken is None else taken.unionByName(sure)
        left = stored(left.join(sure.select("old_path"), "old_path", "left_anti").join(sure.select("new_path"), "new_path", "left_anti").select(*edges.columns), "left")
        if left.isEmpty():
            return taken
    # ends go by a hash: two that share one lie in one component, whose edges are gone through in order all the same
    name = lambda kind, c: F.xxhash64(F.lit(kind), c)
    found = components(left.select(name("o", "old_path").alias("u"), name("n", "new_path").alias("v")))
    placed = left.join(found.select(F.col("node").alias("__node"), F.col("component").alias("__c")), name("o", "old_path") == F.col("__node")).drop("__node")

    def one_by_one(batches):
        key, olds, news = None, set(), set()
        for batch in batches:
            keep = []
            for c, o, n in zip(batch["__c"].tolist(), batch["old_path"].tolist(), batch["new_path"].tolist(), strict=True):
                if c != key:
                    key, olds, news = c, set(), set()
                free = o not in olds and n not in news
                if free:
                    olds.add(o)
                    news.add(n)
                keep.append(free)
            yield batch[keep].drop(columns="__c")

    rest = placed.select("__c", *edges.columns).repartition("__c").sortWithinPartitions("__c", *order).mapInPandas(one_by_one, edges.schema)
    return taken.unionByName(rest)


def _first_of(edges: DataFrame) -> list[Column]:
    """Of edges that are given more than once the one of the highest score, whole."""
    more = [c for c in edges.columns if c not in ("old_path", "new_path")]
    return [F.max_by(c, "score").alias(c) for c in more]


# Change log


def record_changes(plan: DataFrame, run_id: str) -> DataFrame:
    """A row a remote write with the content before and the hash after, numbered by kind."""
    writes = plan.where(F.col("outcome").isin("PUSH", "CREATE", "DELETE_REMOTE", "MOVE_EDIT"))
    writes = numbered(writes, ["kind"], ["id", "path"], "seq")
    return writes.select(F.lit(run_id).alias("run_id"), "kind", "seq", "outcome", "path", "id", F.col("remote_hash").alias("preimage"), F.when(F.col("outcome") != "DELETE_REMOTE", F.col("local_hash")).alias("post_write_hash"))


def restore_run(log: DataFrame, now: DataFrame) -> DataFrame:
    """``kind, id, action, content`` that takes a run back: the earliest content of a record, where its present hash is the latest written."""
    net = log.groupBy("kind", "id").agg(F.min_by("preimage", "seq").alias("preimage"), F.max_by("post_write_hash", "seq").alias("post"), F.min_by("outcome", "seq").alias("first_op"))
    joined = net.join(now, ["kind", "id"], "left")
    action = (
        F.when(F.col("post").isNull(), "recreate").when(~F.col("post").eqNullSafe(F.col("now_hash")), "report").when(F.col("first_op") == "CREATE", "delete").otherwise("write back")
    )
    return joined.select("kind", "id", action.alias("action"), F.when(action.isin("recreate", "write back"), F.col("preimage")).alias("content"))


#: The headings of a project's context, in order.
CONTEXT_HEADINGS = ["## Scope", "## Objectives", "## Targets", "## White cards", "## Collab note"]


def project_context(projects: DataFrame, scopes: DataFrame, objectives: DataFrame, targets: DataFrame, cards: DataFrame) -> DataFrame:
    """``project_id, context``: one text a project, with a section for each kind of child row that it has.

    projects (project_id, codename, client); scopes (project_id, pos, name, entries, disallowed, caution); objectives
    (project_id, pos, objective, status, priority, deadline, complete); targets (project_id, pos, hostname, ip, compromised); cards
    (project_id, pos, title, issued). Where they have them, projects also bring start, end and collab (HTML), objectives a result, and all child
    rows a description (HTML in cards). Child rows become text where they are and meet in one shuffle, sorted by pos. A project's own
    rows are the text's size, so no larger than one row of the result.
    """
    some = lambda c: F.when(F.length(c) > 0, F.col(c))
    text = lambda table, c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) if c in table.columns else F.lit("")
    after = lambda value, gap: F.when(value != "", F.concat(F.lit(gap), value)).otherwise("")
    flags = F.concat_ws(", ", F.when(F.col("disallowed"), "EXCLUDED"), F.when(F.col("caution"), "CAUTION"))
    entries = F.filter(F.transform(F.split(F.coalesce("entries", F.lit("")), "\r?\n"), lambda e: F.trim(e)), lambda e: e != "")
    listed = F.when(F.size(entries) > 0, F.concat(F.lit("\n\n"), F.array_join(F.transform(entries, lambda e: F.concat(F.lit("- "), e)), "\n"))).otherwise("")
    bits = F.concat_ws(" / ", some("status"), some("priority"))
    address = F.concat_ws(" / ", some("hostname"), some("ip"))
    parts = [
        (scopes, F.concat(F.lit("\n### "), F.coalesce(some("name"), F.lit("Scope")), F.when(flags != "", F.concat(F.lit(" ("), flags, F.lit(")"))).otherwise(""), after(text(scopes, "description"), "\n\n"), listed)),
        (objectives, F.concat(
            F.lit("- **"), F.coalesce("objective", F.lit("")), F.lit("**"), F.when(bits != "", F.concat(F.lit(" \u2014 "), bits)).otherwise(""),
            F.when(F.length("deadline") > 0, F.concat(F.lit(" (deadline: "), F.col("deadline"), F.lit(")"))).otherwise(""), F.when(F.col("complete"), " [COMPLETE]").otherwise(""),
            after(text(objectives, "description"), "\n  "), after(text(objectives, "result"), "\n  Result: "),
        )),
        (targets, F.concat(F.lit("- "), F.when(address != "", address).otherwise("unknown target"), F.when(F.col("compromised"), " (COMPROMISED)").otherwise(""), after(text(targets, "description"), "\n  "))),
        (cards, F.concat(F.lit("\n### "), F.coalesce("title", F.lit("")), F.when(F.length("issued") > 0, F.concat(F.lit(" \u2014 "), F.col("issued"))).otherwise(""), after(html_to_text(text(cards, "description")), "\n\n"))),
    ]
    start, end = text(projects, "start"), text(projects, "end")
    dated = F.when((start != "") | (end != ""), F.concat(F.lit("**Dates:** "), start, F.lit(" \u2013 "), end))
    about = F.concat_ws("\n", F.when(F.length("client") > 0, F.concat(F.lit("**Client:** "), F.col("client"))), dated)
    heads = projects.select("project_id", F.lit(-1).alias("section"), F.lit(0).cast("long").alias("pos"), F.concat(
        F.lit("# "), F.coalesce(some("codename"), some("client"), F.lit("Project")), after(about, "\n\n"),
    ).alias("text"), F.lit(True).alias("is_project"))
    collab = projects.select("project_id", F.lit(4).alias("section"), F.lit(0).cast("long").alias("pos"), html_to_text(text(projects, "collab")).alias("text"), F.lit(False).alias("is_project")).where("text <> ''")
    rows = heads.unionByName(collab)
    for k, (table, text) in enumerate(parts):
        rows = rows.unionByName(table.select("project_id", F.lit(k).alias("section"), F.col("pos").cast("long").alias("pos"), text.alias("text"), F.lit(False).alias("is_project")))
    grouped = rows.groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("section", "pos", "text"))).alias("a"), F.max("is_project").alias("known")).where("known")
    titles = F.array(*[F.lit(h) for h in CONTEXT_HEADINGS])
    a = F.col("a")

    def line(x: Column, i: Column) -> Column:
        first = (x["section"] >= 0) & (F.get(a, i - 1)["section"] != x["section"])
        # lists stand off their heading, titled entries bring their own empty line
        gap = F.when(x["section"].isin(1, 2, 4), "\n\n").otherwise("\n")
        return F.when(first, F.concat(F.lit("\n"), F.get(titles, x["section"]), gap, x["text"])).otherwise(x["text"])

    return grouped.select("project_id", F.concat(F.array_join(F.transform(a, line), "\n"), F.lit("\n")).alias("context"))
