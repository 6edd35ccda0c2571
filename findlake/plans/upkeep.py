"""Registered queries of tables that are kept up, of matching and of names, each beside its DuckDB twin where SQL has one."""

from __future__ import annotations

from pyspark.sql import functions as F

from findlake.functions import text
from findlake.operators import documents, lookups, occurrences, reconcile, records, rules
from findlake.operators.numbering import scratch_folder
from findlake.plans.queries import OCC, query, read
from findlake.streaming import findings

STREAM = "ts timestamp, scan_id long, pos long, key long, sev_rank int"


@query("SELECT CAST(user_id AS VARCHAR) AS key, CAST(max(CAST(floor(value) AS BIGINT) % 5) AS INTEGER) AS sev_rank, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_seen, count(*) AS n_occurrences FROM events GROUP BY user_id")
def str1_stream(spark, sf_dir):
    """A finding table kept up by a stream of four files and the replay of a third of them, two files a micro-batch, folded halfway.

    Every occurrence counts once, though a third come again in a later batch; the delay covers all days of the events.
    """
    base = scratch_folder(spark, "stream")
    rows = read(spark, sf_dir, "events").select("ts", (F.col("event_id") % 7).alias("scan_id"), F.col("event_id").alias("pos"), F.col("user_id").alias("key"), (F.floor("value") % 5).cast("int").alias("sev_rank"))
    rows.repartition(4, "pos").write.parquet(f"{base}/in")
    stream = spark.readStream.schema(STREAM).option("maxFilesPerTrigger", 2).parquet(f"{base}/in")
    run = lambda: findings.maintain_findings(stream, f"{base}/table", f"{base}/checkpoint", delay="60 days").awaitTermination()
    run()
    findings.compact(spark, f"{base}/table")
    rows.where("pos % 3 = 0").coalesce(1).write.mode("append").parquet(f"{base}/in")
    run()
    return findings.current_findings(spark, f"{base}/table").select("key", "sev_rank", F.date_format("first_seen", "yyyy-MM-dd HH:mm:ss").alias("first_seen"), "n_occurrences")


@query("""WITH d AS (SELECT doc_id, doc_id % 5 AS k, text FROM documents), s AS (SELECT doc_id || '.md' AS path, CASE WHEN k = 1 OR text IS NULL THEN 'failed' WHEN k = 2 AND doc_id % 3 = 0 THEN 'written' ELSE 'unchanged' END AS state,
 CASE WHEN k = 2 AND doc_id % 3 = 0 THEN text || '!' ELSE text END AS content FROM d) SELECT path, state, md5(content) AS digest FROM s""")
def log5_write_findings(spark, sf_dir):
    """A table of findings written from whole texts, then with changes to some of them and none to others; some fail and keep what there was."""
    table = f"{scratch_folder(spark, 'findings')}/table"
    k = F.col("doc_id") % 5
    docs = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.col("text").alias("content"))
    records.write_findings(docs, table)
    changed = F.when(k == 1, F.lit(None).cast("string")).when((k == 2) & (F.col("doc_id") % 3 == 0), F.concat("content", F.lit("!"))).otherwise(F.col("content"))
    told = records.write_findings(docs.withColumn("content", changed), table)
    return told.join(spark.read.parquet(table).select("path", F.md5("content").alias("digest")), "path", "left")


@query(OCC + " SELECT key, max(sev_rank) AS sev_rank, count(DISTINCT pos // 10) AS exact_scans, true AS near, count(*) AS n_occurrences FROM occ GROUP BY key")
def agg4_sketched_rollup(spark, sf_dir):
    """Scans of a key from sketches kept by day and key, beside the exact count: nearer than four standard errors, or than 2."""
    rows = read(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), F.floor(F.col("event_id") / 10).alias("scan_id"), F.col("user_id").alias("key"), (F.floor("value") % 5).alias("sev_rank"), F.to_date("ts").alias("day"))
    found = occurrences.approximate_rollup(occurrences.scan_sketches(rows, ["day", "key"]))
    exact = rows.groupBy("key").agg(F.count_distinct("scan_id").alias("exact_scans"))
    near = F.abs(F.col("n_scans") - F.col("exact_scans")) <= F.greatest(F.lit(2.0), F.col("exact_scans") * 4 * 1.04 / 64)
    return found.join(exact, "key").select("key", "sev_rank", "exact_scans", near.alias("near"), "n_occurrences")


# The ratio of matching blocks has no SQL form; a test holds the pairs against all pairs, with the loop's own order of arguments.
@query()
def mat1_similar_pairs(spark, sf_dir):
    """Near texts among the whole documents of one language and first word: those of even ids as what is missing, the others as what is new."""
    first = F.lower(F.regexp_extract("text", r"^\s*(\S*)", 1))
    rows = read(spark, sf_dir, "documents").where("text is not null").select(F.concat_ws("/", "lang", first).alias("block"), F.col("doc_id").alias("path"), "text")
    return lookups.similar_pairs(rows.where("path % 2 = 0"), rows.where("path % 2 = 1"))


@query("""WITH o AS (SELECT *, CASE WHEN o_orderkey % 10 = 0 THEN 'H' || o_orderkey // 20 END AS h FROM orders),
e AS (SELECT a.o_orderkey AS old_path, b.o_orderkey AS new_path, 1.0 AS score, false AS edited FROM o a JOIN o b ON a.h = b.h AND a.o_orderkey % 20 = 0 AND b.o_orderkey % 20 = 10),
n AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 10 = 3), total AS (SELECT max(k) AS top FROM n)
SELECT old_path, new_path, score, edited FROM e UNION ALL SELECT k AS old_path, k + 1 AS new_path, 0.6::DOUBLE + 0.3::DOUBLE * k / top AS score, true AS edited FROM n, total""")
def mat3_greedy_match(spark, sf_dir):
    """Identical and scored edges in one run: pairs of equal hashes, and one chain through a tenth of all orders whose scores rise to its end.

    An old path k of the chain has an edge to k + 1 and one of a lower score to the new path of the one before it, which that one has as its
    only other choice; so each round of best edges settles the end of the chain and no more.
    """
    orders = read(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    hashes = orders.where(key % 10 == 0).select(key.alias("path"), F.concat(F.lit("H"), F.floor(key / 20).cast("string")).alias("hash"))
    same = lookups.identical_edges(hashes.where("path % 20 = 0"), hashes.where("path % 20 = 10"))
    top = orders.where(key % 10 == 3).agg(F.max(key).alias("top"))
    chain = orders.where(key % 10 == 3).select(key.alias("k")).join(F.broadcast(top)).withColumn("score", F.lit(0.6) + F.lit(0.3) * F.col("k") / F.col("top"))
    own = chain.select(F.col("k").alias("old_path"), (F.col("k") + 1).alias("new_path"), "score", F.lit(True).alias("edited"))
    back = chain.where("k > 3").select(F.col("k").alias("old_path"), (F.col("k") - 9).alias("new_path"), (F.lit(0.6) + F.lit(0.3) * (F.col("k") - 5) / F.col("top")).alias("score"), F.lit(True).alias("edited"))
    return lookups.greedy_match(same.unionByName(own).unionByName(back))


@query()
def win3_names_exact(spark, sf_dir):
    """Names of all parts and of all orders in one folder a status, with names among them that look like numbered ones."""
    orders = read(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    name = F.when(k % 11 == 0, F.concat(F.lit("n-"), (k % 300 + 2).cast("string"))).when(k % 13 == 0, F.concat(F.lit("n-2-"), (k % 7 + 2).cast("string"))).otherwise("n")
    return lookups.dedupe_names_exact(orders.select(k.alias("id"), F.col("o_orderstatus").alias("folder"), name.alias("name")))


NAMES = ["a%d.png", ".hid%d.png", "b%d.remote.png", "c\\%d.png", "d%d.gif", "Ü %d.PNG", "e%d.exe", "L%d.png"]


@query(r"""WITH f AS (SELECT o_orderkey AS k, o_orderkey % 8 AS i, o_orderkey % 3 AS p, ['a' || o_orderkey || '.png', '.hid' || o_orderkey || '.png', 'b' || o_orderkey || '.remote.png', 'c\' || o_orderkey || '.png', 'd' || o_orderkey || '.gif', 'Ü ' || o_orderkey || '.PNG', 'e' || o_orderkey || '.exe', repeat('L', 260) || o_orderkey || '.png'][o_orderkey % 8 + 1] AS name FROM orders),
w AS (SELECT *, ['findings/reports/r/evidence/', 'methodology/library/b/images/', 'findings/reports/r/'][p + 1] || name AS path FROM f)
SELECT 'REF-008' AS rule_id, path, [NULL, 'leading dot', 'sidecar name', 'separator', NULL, NULL, NULL, 'too long'][i + 1] AS message FROM w WHERE p < 2 AND i IN (1, 2, 3, 7)
UNION ALL SELECT 'REF-009', path, CASE i WHEN 4 THEN 'use png' ELSE 'not allowed' END FROM w WHERE p = 0 AND i IN (4, 6)""")
def ref008_ref009_file_sets(spark, sf_dir):
    key = F.col("o_orderkey")
    name = F.replace(F.replace(F.element_at(F.array(*map(F.lit, NAMES)), (key % 8 + 1).cast("int")), F.lit("%d"), key.cast("string")), F.lit("L"), F.repeat(F.lit("L"), F.lit(260)))
    folder = F.element_at(F.array(*map(F.lit, ["findings/reports/r/evidence/", "methodology/library/b/images/", "findings/reports/r/"])), (key % 3 + 1).cast("int"))
    return rules.file_set_rules(read(spark, sf_dir, "orders").select(F.concat(folder, name).alias("path")))


@query(r"""WITH e AS (SELECT o_orderkey AS k, o_orderkey % 7 AS i, ['p/' || o_orderkey, '', 'p\' || o_orderkey, '/p/' || o_orderkey, 'p/../' || o_orderkey, 'p/' || o_orderkey, 'p/' || o_orderkey][o_orderkey % 7 + 1] AS path,
 CASE WHEN o_orderkey % 7 = 5 THEN 'user' ELSE 'page' END AS kind, CASE WHEN o_orderkey % 7 = 6 THEN 'x' || o_orderkey WHEN o_orderkey % 70 < 2 THEN '-7' ELSE o_orderkey::VARCHAR END AS id FROM orders)
SELECT 'IDX-001' AS rule_id, path, ['', 'empty path', 'backslash', 'absolute path', 'parent segment', 'unknown kind', 'no integer id'][i + 1] AS message FROM e WHERE i > 0
UNION ALL SELECT 'IDX-001', path, 'identity page -7 twice' FROM e WHERE id = '-7' AND kind = 'page'""")
def idx001_entries(spark, sf_dir):
    key, text = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    forms = [F.concat(F.lit("p/"), text), F.lit(""), F.concat(F.lit("p\\"), text), F.concat(F.lit("/p/"), text), F.concat(F.lit("p/../"), text), F.concat(F.lit("p/"), text), F.concat(F.lit("p/"), text)]
    entries = read(spark, sf_dir, "orders").select(F.element_at(F.array(*forms), (key % 7 + 1).cast("int")).alias("path"), F.when(key % 7 == 5, "user").otherwise("page").alias("kind"), F.when(key % 7 == 6, F.concat(F.lit("x"), text)).when(key % 70 < 2, "-7").otherwise(text).alias("id"))
    return lookups.index_problems(entries, ["page", "book", "report"])


@query("""WITH e AS (SELECT p_partkey AS doc_id, p_size AS report, p_type AS path, CASE WHEN p_partkey % 4 = 0 THEN ' ' WHEN p_partkey % 50 = 1 THEN repeat('c', 256) ELSE p_brand END AS caption FROM part),
d AS (SELECT report, path, count(DISTINCT caption) FILTER (trim(caption) <> '') AS n FROM e GROUP BY ALL HAVING n > 1)
SELECT 'REF-010' AS rule_id, doc_id, CAST(3 AS INTEGER) AS line, path || ': 256 characters' AS message FROM e WHERE length(caption) > 255 UNION ALL SELECT 'REF-004', doc_id, 3, path || ': ' || n || ' captions' FROM e JOIN d USING (report, path)""")
def ref004_ref010_captions(spark, sf_dir):
    caption = F.when(F.col("p_partkey") % 4 == 0, " ").when(F.col("p_partkey") % 50 == 1, F.repeat(F.lit("c"), F.lit(256))).otherwise(F.col("p_brand"))
    return lookups.caption_rules(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_size").alias("report"), F.col("p_type").alias("path"), caption.alias("caption"), F.lit(3).alias("line")))


FAILED = "SELECT ['FND-001', 'WS-002', 'WIKI-006'][o_orderkey % 3 + 1] AS rule_id, CASE WHEN o_orderkey % 4 = 0 THEN 'methodology' ELSE 'findings' END || '/' || o_orderkey AS path FROM orders WHERE o_orderkey % 5 = 0"


@query(f"SELECT regexp_extract(rule_id, '^([A-Z]+)', 1) AS family, split_part(path, '/', 1) AS area, count(*) AS n_failures FROM ({FAILED}) GROUP BY CUBE (regexp_extract(rule_id, '^([A-Z]+)', 1), split_part(path, '/', 1))")
def agg16_rule_cube(spark, sf_dir):
    key = F.col("o_orderkey")
    failed = read(spark, sf_dir, "orders").where(key % 5 == 0).select(F.element_at(F.array(*map(F.lit, ["FND-001", "WS-002", "WIKI-006"])), (key % 3 + 1).cast("int")).alias("rule_id"), F.concat(F.when(key % 4 == 0, "methodology/").otherwise("findings/"), key.cast("string")).alias("path"))
    return documents.rule_cube(failed)


@query("SELECT kind, outcome, path FROM (SELECT o_orderpriority AS kind, CASE o_orderkey % 4 WHEN 0 THEN 'CLEAN' WHEN 1 THEN 'COLLISION' WHEN 2 THEN 'INVALID' ELSE 'PUSH' END AS outcome, 'p/' || o_orderkey AS path FROM orders) WHERE outcome IN ('COLLISION', 'INVALID')")
def agg6_problem_paths(spark, sf_dir):
    key = F.col("o_orderkey")
    plan = read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("kind"), F.element_at(F.array(*map(F.lit, ["CLEAN", "COLLISION", "INVALID", "PUSH"])), (key % 4 + 1).cast("int")).alias("outcome"), F.concat(F.lit("p/"), key.cast("string")).alias("path"))
    return lookups.problem_paths(plan)


@query("SELECT 'p/' || o_orderkey || CASE WHEN o_orderkey % 3 = 0 THEN '.remote' ELSE '.remote.md' END AS path FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 5 <> 0")
def rec18_stale_sidecars(spark, sf_dir):
    """Sidecars of every second record; every fifth record is still in collision."""
    key = F.col("o_orderkey")
    path = F.concat(F.lit("p/"), key.cast("string"), F.when(key % 3 == 0, "").otherwise(".md"))
    orders = read(spark, sf_dir, "orders").select(path.alias("path"), F.when(key % 5 == 0, "COLLISION").otherwise("CLEAN").alias("outcome"), key.alias("key"))
    files = orders.where("key % 2 = 0").select(text.sidecar_name(F.col("path")).alias("path")).unionByName(orders.select("path"))
    return reconcile.stale_sidecars(orders, files)


@query("SELECT o_orderkey, o_custkey AS report, o_orderkey % 100000 AS spec FROM orders")
def sca21_composite_parts(spark, sf_dir):
    """Numbers made of two, and taken apart again; the second of a pair is below 100,000."""
    made = read(spark, sf_dir, "orders").select("o_orderkey", text.composite_id(F.col("o_custkey"), F.col("o_orderkey") % 100000).alias("n"))
    return made.select("o_orderkey", text.composite_parts(F.col("n")).alias("x")).select("o_orderkey", "x.report", "x.spec")
