"""Three-way reconciliation of local, remote and last-synced records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findlake.functions.text import sidecar_name

from findlake.operators.numbering import numbered

REMOTE_WRITES = ["PUSH", "CREATE", "DELETE_REMOTE", "MOVE_EDIT"]
LOCAL_LOSSES = ["PULL", "DELETE_LOCAL"]


def fingerprint(*columns: str) -> Column:
    """A content hash of columns, whatever order they are named in; null and empty differ."""
    return F.concat(F.lit("sha256:"), F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"}), 256))


def partition_present(local: DataFrame, indexed: DataFrame, key: str = "path") -> DataFrame:
    """``key, state``: present (both), missing (indexed only) or unindexed (local only)."""
    l, i = local.select(key).distinct().withColumn("__l", F.lit(True)), indexed.select(key).distinct().withColumn("__i", F.lit(True))
    state = F.when(F.col("__l").isNull(), "missing").when(F.col("__i").isNull(), "unindexed").otherwise("present")
    return l.join(i, key, "full").select(key, state.alias("state"))


def three_way_join(local: DataFrame, index: DataFrame, remote: DataFrame, state: DataFrame) -> DataFrame:
    """One slot a record from local (path, kind, local_hash), index (path, kind, id), remote (kind, id, remote_hash, ...) and
    state (kind, id, base_hash), and the remote rows that no slot has.

    Sides meet on path, then on (kind, id): two shuffles of each, none on a key that many rows share.
    """
    slots = local.withColumnRenamed("kind", "__local_kind").join(index.withColumn("indexed", F.lit(True)), "path", "full")
    slots = slots.withColumn("kind", F.coalesce("kind", "__local_kind")).drop("__local_kind")
    both = slots.join(remote.withColumn("__remote", F.lit(True)), ["kind", "id"], "full").join(state, ["kind", "id"], "left")
    return both.withColumn("indexed", F.coalesce("indexed", F.lit(False)))


def classify(slots: DataFrame, mode: str = "mode", clamp_unindexed: bool = False) -> DataFrame:
    """``outcome`` of each slot (indexed, local_hash, remote_hash, base_hash; a null hash: not there; mode read-write,
    read-only or append-only).

    Sides that agree are clean even where the base is unknown; sides that differ then collide.
    """
    l, r, b = F.col("local_hash"), F.col("remote_hash"), F.col("base_hash")
    both = F.when(l == r, F.when(b.isNotNull() & (b != l), "REPAIR").otherwise("CLEAN")).when(b.isNull(), "COLLISION").when(r == b, "PUSH").when(l == b, "PULL").otherwise("COLLISION")
    known = (
        F.when(l.isNotNull() & r.isNotNull(), both).when(l.isNotNull(), F.when(l == b, "DELETE_LOCAL").otherwise("COLLISION"))
        .when(r.isNotNull(), F.when(r == b, "DELETE_REMOTE").otherwise("COLLISION")).otherwise("FORGET")
    )
    fresh = F.when(l.isNotNull(), "CREATE").when(r.isNotNull(), "PULL_NEW").otherwise("FORGET")
    read_only = known.isin("PUSH", "CREATE", "DELETE_REMOTE", "COLLISION") & F.col(mode).isin("read-only", "append-only")
    indexed = F.when(read_only, "INVALID").otherwise(known)
    unindexed = F.when((F.col(mode) == "append-only") & l.isNull() & r.isNotNull(), "CLEAN")
    if clamp_unindexed:
        unindexed = unindexed.when((F.col(mode) == "read-only") & l.isNotNull(), "INVALID")
    return slots.withColumn("outcome", F.when(F.col("indexed"), indexed).otherwise(unindexed.otherwise(fresh)))


def apply_force(plan: DataFrame, force: DataFrame, mode: str = "mode") -> DataFrame:
    """Overrides from ``force`` (path, side: local or remote); sets ``forced`` where the outcome follows one."""
    joined = plan.join(force.groupBy("path").agg(F.min("side").alias("__side")), "path", "left")
    o, local, remote = F.col("outcome"), F.col("__side") == "local", F.col("__side") == "remote"
    new = (
        F.when((o == "COLLISION") & local, F.when(F.col("local_hash").isNull(), "DELETE_REMOTE").otherwise("PUSH")).when((o == "COLLISION") & remote, F.when(F.col("remote_hash").isNull(), "DELETE_LOCAL").otherwise("PULL"))
        .when((o == "DELETE_REMOTE") & remote, "PULL").when((o == "DELETE_LOCAL") & local & (F.col(mode) == "read-write"), "CREATE")
    )
    return joined.withColumn("forced", new.isNotNull()).withColumn("outcome", F.coalesce(new, o)).drop("__side")


def validation_gate(plan: DataFrame, failures: DataFrame) -> DataFrame:
    """Remote writes of a path with failures become INVALID, with the ids of the rules; pulls go on."""
    rules = failures.groupBy("path").agg(F.array_sort(F.collect_set("rule_id")).alias("rule_ids"))
    stopped = F.col("outcome").isin(*REMOTE_WRITES) & F.col("rule_ids").isNotNull()
    return plan.drop("rule_ids").join(rules, "path", "left").withColumn("outcome", F.when(stopped, "INVALID").otherwise(F.col("outcome"))).withColumn("rule_ids", F.when(stopped, F.col("rule_ids")))


def veto(plan: DataFrame) -> DataFrame:
    """SKIP for remote rows that are recycled, of another editor, or a draft or template; sets reason and attention."""
    open_ = ~F.col("outcome").isin("CLEAN", "REPAIR", "FORGET", "INVALID")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    other = F.coalesce(F.col("editor"), F.lit("markdown")) != "markdown"
    reason = F.when(open_ & flag("recycled"), "recycled").when(open_ & other, "editor").when(open_ & (flag("draft") | flag("template")), "draft or template")
    attention = F.when(reason == "recycled", "attention").when(reason == "editor", F.when(F.col("local_hash").isNotNull(), "attention").otherwise("info")).when(reason.isNotNull(), "info")
    return plan.withColumn("reason", reason).withColumn("attention", attention).withColumn("outcome", F.when(F.col("reason").isNotNull(), "SKIP").otherwise(F.col("outcome")))


def change_guard(plan: DataFrame, group: Sequence[str] = ("kind",), ratio: float = 0.2, least: int = 5, bypass: bool = False) -> DataFrame:
    """WITHHELD for writes of a kind that are too many: over ``least`` and over ``ratio`` of all its plans, deletes counting twice.

    Remote and local writes are weighed apart; forced ones and moves don't count. Weights are summed before the shuffle and
    come back as a row a kind, so that a large kind isn't gathered.
    """
    if bypass:
        return plan
    o, free = F.col("outcome"), ~F.coalesce(F.col("forced"), F.lit(False))
    weight = lambda names, double: F.sum(F.when(free & (o == double), 2).when(free & o.isin(*names), 1).otherwise(0))
    sums = plan.groupBy(*group).agg(weight(REMOTE_WRITES, "DELETE_REMOTE").alias("__w"), weight(LOCAL_LOSSES, "DELETE_LOCAL").alias("__d"), F.greatest(F.count("*"), F.lit(1)).alias("__n"))
    over = lambda w: (F.col(w) > least) & (F.col(w) > ratio * F.col("__n"))
    held = free & ((over("__w") & o.isin(*REMOTE_WRITES)) | (over("__d") & o.isin(*LOCAL_LOSSES)))
    # a row a kind, of which there are about ten
    return plan.join(F.broadcast(sums), list(group), "left").withColumn("outcome", F.when(F.coalesce(held, F.lit(False)), "WITHHELD").otherwise(o)).drop("__w", "__d", "__n")


def reconcile(slots: DataFrame, failures: DataFrame, force: DataFrame) -> DataFrame:
    """Classify, force, gate, veto and guard, in that order."""
    return change_guard(veto(validation_gate(apply_force(classify(slots), force), failures)))


def apply_plan(plan: DataFrame) -> DataFrame:
    """The next snapshot: path, kind, id, hash of every record that is left after the plan.

    A push and a create leave the local content, a pull the remote's; deletions and forgotten slots leave. What isn't carried
    out (collisions, invalid, skipped, withheld) keeps both sides and the old base. New records are numbered by path
    after the highest id of their kind.
    """
    o = F.col("outcome")
    gone = o.isin("DELETE_LOCAL", "DELETE_REMOTE", "FORGET")
    done = o.isin("CLEAN", "REPAIR", "PUSH", "PULL", "CREATE", "PULL_NEW")
    local = F.when(o.isin("PULL", "PULL_NEW"), F.col("remote_hash")).otherwise(F.col("local_hash"))
    remote = F.when(o.isin("PUSH", "CREATE"), F.col("local_hash")).otherwise(F.col("remote_hash"))
    kept = plan.where(~gone).select(
        F.coalesce("path", F.concat_ws("/", F.col("kind"), F.col("id").cast("string"))).alias("path"), "kind", "id", "mode", local.alias("local_hash"), remote.alias("remote_hash"),
        F.when(done, local).otherwise(F.col("base_hash")).alias("base_hash"), (F.col("indexed") | done).alias("indexed"),
    )
    # an id is one of its kind, so that kinds are numbered apart
    top = kept.groupBy("kind").agg(F.coalesce(F.max("id"), F.lit(0)).alias("__top"))
    new = numbered(kept.where("id is null").drop("id"), ["kind"], ["path"], "id")
    return kept.where("id is not null").unionByName(new.join(F.broadcast(top), "kind").withColumn("id", F.col("id") + F.col("__top")).drop("__top"))


def drift_check(plan: DataFrame, now: DataFrame) -> DataFrame:
    """COLLISION for unforced remote writes whose record has changed or gone since it was classified; ``now`` is (kind, id, now_hash)."""
    moved = F.col("outcome").isin("PUSH", "DELETE_REMOTE", "MOVE_EDIT") & ~F.coalesce(F.col("forced"), F.lit(False)) & ~F.col("now_hash").eqNullSafe(F.col("remote_hash"))
    return plan.join(now, ["kind", "id"], "left").withColumn("outcome", F.when(moved, "COLLISION").otherwise(F.col("outcome"))).drop("now_hash")


def relocate(plan: DataFrame, existing: DataFrame) -> DataFrame:
    """``new_path, outcome`` where the remote's parent has changed: MOVE, or FAILED where another file is there."""
    moved = F.col("remote_parent").isNotNull() & (F.col("remote_parent") != F.regexp_extract("path", r"^(.*)/[^/]*$", 1))
    target = F.when(moved, F.concat_ws("/", F.col("remote_parent"), F.regexp_extract("path", r"([^/]*)$", 1)))
    taken = existing.select(F.col("path").alias("new_path"), F.lit(True).alias("__taken")).distinct()
    return plan.withColumn("new_path", target).where("new_path is not null").join(taken, "new_path", "left").withColumn("outcome", F.when(F.col("__taken"), "FAILED").otherwise("MOVE")).drop("__taken")


def offline_status(local: DataFrame, indexed: DataFrame, failures: DataFrame) -> DataFrame:
    """``path, kind, status`` without the remote: clean, edited, new, deleted, moved or unknown; invalid where a rule fails.

    A missing record and a new file of the same content are one that moved; they are paired in order of path.
    """
    both = local.join(indexed.select("path", "kind", "base_hash", F.lit(True).alias("__i")), ["path", "kind"], "full")
    status = F.when(F.col("__i").isNull(), "new").when(F.col("local_hash").isNull(), "deleted").when(F.col("base_hash").isNull(), "unknown").when(F.col("local_hash") == F.col("base_hash"), "clean").otherwise("edited")
    rows = both.withColumn("status", status)
    gone = rows.where("status = 'deleted' and base_hash is not null").select("kind", F.col("base_hash").alias("h"), F.col("path").alias("move_from"))
    new = rows.where("status = 'new' and local_hash is not null").select("kind", F.col("local_hash").alias("h"), "path")
    gone, new = numbered(gone, ["kind", "h"], ["move_from"], "k"), numbered(new, ["kind", "h"], ["path"], "k")
    moves = new.join(gone, ["kind", "h", "k"]).select("path", "kind", "move_from")
    rest = rows.join(moves.select(F.col("move_from").alias("path"), "kind"), ["path", "kind"], "left_anti").join(moves, ["path", "kind"], "left")
    bad = failures.select("path").distinct().withColumn("__bad", F.lit(True))
    final = F.when(F.col("__bad") & F.col("local_hash").isNotNull(), "invalid").when(F.col("move_from").isNotNull(), "moved").otherwise(F.col("status"))
    return rest.join(bad, "path", "left").select("path", "kind", final.alias("status"), "move_from")


def mirror_state(recorded: Column, current: Column, new: Column) -> Column:
    """written, unchanged or hand-edited, from the recorded digest and the texts there and to come."""
    there = F.sha2(current, 256)
    return F.when(current.isNull(), "written").when(recorded.isNull() | (recorded != there), "hand-edited").when(there == F.sha2(new, 256), "unchanged").otherwise("written")


def lookup_drift(live: DataFrame, expected: DataFrame) -> DataFrame:
    """``id, problem`` of a lookup table (id, name): missing, renamed or unknown."""
    both = live.withColumnRenamed("name", "live_name").join(expected.withColumnRenamed("name", "expected_name"), "id", "full")
    problem = F.when(F.col("live_name").isNull(), "missing").when(F.col("expected_name").isNull(), "unknown").when(F.col("live_name") != F.col("expected_name"), "renamed")
    return both.select("id", problem.alias("problem")).where("problem is not null")


def changed_since_witness(remote: DataFrame, state: DataFrame, witness: Sequence[str]) -> DataFrame:
    """``changed`` for each remote row: its witness differs from the stored one, or no base is stored."""
    old = state.select("id", "base_hash", *[F.col(c).alias(f"__{c}") for c in witness])
    same = F.col("base_hash").isNotNull()
    for c in witness:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return remote.join(old, "id", "left").withColumn("changed", ~same).drop(*[f"__{c}" for c in witness])


FILE_REFERENCE = r"!?\[[^\]\n]*\]\((?:\.\./)?FOLDER/[^)\s]+(?:\s+\"[^\"]*\")?\)"
EMBED_LINE = r"(?m)^[ \t]*!\[[^\]\n]*\]\((?:\.\./)?FOLDER/[^)\s]+(?:\s+\"[^\"]*\")?\)[ \t]*$"


def _replace_references(docs: DataFrame, files: DataFrame, pattern: str, folder_name: str, token: Column, out: str) -> DataFrame:
    """``docs`` (doc_id, folder, text) with ``out``: the text with each match replaced by ``token`` (of ``m`` and the file's columns).

    Only matches are exploded and shuffled, to the files by (folder, filename) and back by doc_id; a document's
    matches are as many as its text holds. Texts without a match come out as they are.
    """
    pattern = pattern.replace("FOLDER", folder_name)
    found = docs.select("doc_id", "folder", F.posexplode(F.regexp_extract_all("text", F.lit(pattern), 0)).alias("k", "m"))
    named = found.withColumn("filename", F.regexp_extract("m", rf"\]\((?:\.\./)?{folder_name}/([^)\s]+)", 1))
    told = named.join(files, ["folder", "filename"], "left").select("doc_id", "k", token.alias("t"))
    tokens = told.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "t"))), lambda x: x["t"]).alias("__t"))
    between = F.split("text", pattern)
    joined = F.array_join(F.zip_with(between, F.col("__t"), lambda b, t: F.concat(b, F.coalesce(t, F.lit("")))), "")
    return docs.join(tokens, "doc_id", "left").withColumn(out, F.when(F.col("__t").isNull(), F.col("text")).otherwise(joined)).drop("__t")


def prose_with_ids(docs: DataFrame, files: DataFrame, folder_name: str = "evidence", out: str = "prose") -> DataFrame:
    """``docs`` with ``out``: the text without captions, each file reference as the current id of its file.

    ``files`` is (folder, filename, id). Embeds become ``![](id)``, other references ``[id](id)``; a file that is not there
    gives ``unresolved``. The hash of this text changes when a file comes to have another id.
    """
    number = F.coalesce(F.col("id").cast("string"), F.lit("unresolved"))
    token = F.when(F.col("m").startswith("!"), F.concat(F.lit("![]("), number, F.lit(")"))).otherwise(F.concat(F.lit("["), number, F.lit("]("), number, F.lit(")")))
    replaced = _replace_references(docs, files.select("folder", "filename", "id"), FILE_REFERENCE, folder_name, token, out)
    return replaced.withColumn(out, F.regexp_replace(out, r"^\s+|\s+$", ""))


def ripple_push(docs: DataFrame, files_now: DataFrame, state: DataFrame) -> DataFrame:
    """``doc_id, prose, outcome``: PUSH for documents whose text or whose files' ids have changed since ``state`` (doc_id, base_hash)."""
    now = prose_with_ids(docs, files_now)
    same = F.sha2("prose", 256).eqNullSafe(F.col("base_hash"))
    return now.join(state, "doc_id", "left").select("doc_id", "prose", F.when(same, "CLEAN").otherwise("PUSH").alias("outcome"))


def rewrite_captions(docs: DataFrame, captions: DataFrame, folder_name: str = "evidence") -> DataFrame:
    """``doc_id, text`` with the caption and description of each file (folder, filename, caption, description) in its embed lines.

    A line counts where the embed stands alone; embeds of other files stay.
    """
    path = F.regexp_extract("m", r"\]\(([^)\s]+)", 1)
    title = F.when(F.length("description") > 0, F.concat(F.lit(' "'), F.col("description"), F.lit('"'))).otherwise("")
    head, tail = F.regexp_extract("m", r"^([ \t]*)", 1), F.regexp_extract("m", r"([ \t]*)$", 1)
    token = F.when(F.col("caption").isNull(), F.col("m")).otherwise(F.concat(head, F.lit("!["), F.col("caption"), F.lit("]("), path, title, F.lit(")"), tail))
    return _replace_references(docs, captions.select("folder", "filename", "caption", "description"), EMBED_LINE, folder_name, token, "new_text").select("doc_id", F.col("new_text").alias("text"))


def file_set_plan(slots: DataFrame, longest: int = 255) -> DataFrame:
    """Classify files: ``slots`` has the columns of classify() but the hashes, and local_body, remote_body, local_caption, remote_caption, conflict.

    The hash of a side is that of its bytes and caption; without a local caption the remote's counts on both sides. A PUSH of
    other bytes is a MOVE_EDIT (a new remote row); a caption conflict or one of over ``longest`` characters gives FAILED.
    """
    def side(body: str, caption: Column) -> Column:
        return F.when(F.col(body).isNotNull(), F.sha2(F.concat_ws("\n", body, F.coalesce(caption, F.lit(""))), 256))

    own = F.coalesce("local_caption", "remote_caption")
    plan = classify(slots.withColumns({"local_hash": side("local_body", own), "remote_hash": side("remote_body", F.col("remote_caption"))}))
    bad = F.coalesce(F.col("conflict"), F.lit(False)) | (F.coalesce(F.length("local_caption"), F.lit(0)) > longest)
    moved = (F.col("outcome") == "PUSH") & (F.col("local_body") != F.col("remote_body"))
    return plan.withColumn("outcome", F.when(bad & F.col("local_body").isNotNull(), "FAILED").when(moved, "MOVE_EDIT").otherwise(F.col("outcome")))


def stale_sidecars(plan: DataFrame, files: DataFrame) -> DataFrame:
    """``path`` of the sidecars among ``files`` (path) whose record (plan: path, outcome) is no longer in collision."""
    settled = plan.where("path is not null and outcome <> 'COLLISION'").select(sidecar_name(F.col("path")).alias("path"))
    return files.select("path").join(settled.distinct(), "path", "left_semi")
