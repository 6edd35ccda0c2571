"""Tables that are kept up, matching and names, against plain loops."""

import random
from collections import defaultdict
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from findlake.operators import lookups, occurrences, records
from findlake.streaming import findings

OCC = "ts timestamp, scan_id long, pos long, key string, sev_rank int"


def files(folder):
    return {str(p): p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}


def occ_rows(spark, first, last):
    return spark.range(first, last).select(F.timestamp_seconds(F.col("id") * 60 + 1_700_000_000).alias("ts"), (F.col("id") % 3).alias("scan_id"), F.col("id").alias("pos"), (F.col("id") % 5).cast("string").alias("key"), (F.col("id") % 4).cast("int").alias("sev_rank"))


def test_an_occurrence_in_two_batches_counts_once(spark, tmp_path):
    table = str(tmp_path / "table")
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(OCC).parquet(str(tmp_path / "in"))

    def run():
        findings.maintain_findings(stream, table, str(tmp_path / "cp")).awaitTermination()
        return sorted(map(tuple, findings.current_findings(spark, table).collect()))

    assert findings.current_findings(spark, table).count() == 0
    occ_rows(spark, 0, 60).unionByName(occ_rows(spark, 50, 60)).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    occ_rows(spark, 40, 100).write.mode("append").parquet(str(tmp_path / "in"))
    got = run()
    want = sorted(map(tuple, findings.partial_findings(occ_rows(spark, 0, 100)).collect()))
    assert got == want
    # folding changes no row, needs fewer folders, and nothing is folded twice
    assert findings.compact(spark, table) >= 2
    assert sorted(map(tuple, findings.current_findings(spark, table).collect())) == want
    assert findings.compact(spark, table) == 0
    occ_rows(spark, 90, 120).write.mode("append").parquet(str(tmp_path / "in"))
    assert run() == sorted(map(tuple, findings.partial_findings(occ_rows(spark, 0, 120)).collect()))


def test_a_base_without_its_mark_is_not_read(spark, tmp_path):
    table = tmp_path / "table"
    for n in range(2):
        findings.merge_into(occ_rows(spark, n * 10, n * 10 + 10), str(table), n)
    want = sorted(map(tuple, findings.current_findings(spark, str(table)).collect()))
    findings.partial_findings(occ_rows(spark, 0, 5)).write.parquet(str(table / "bases" / "upto=1"))
    (table / "bases" / "upto=1" / "_SUCCESS").unlink()
    assert sorted(map(tuple, findings.current_findings(spark, str(table)).collect())) == want
    findings.compact(spark, str(table))
    assert sorted(map(tuple, findings.current_findings(spark, str(table)).collect())) == want


def test_only_changed_parts_of_the_sink_are_written(spark, tmp_path):
    table = tmp_path / "t"
    docs = spark.range(200).select(F.concat(F.col("id").cast("string"), F.lit(".md")).alias("path"), F.concat(F.lit("c"), F.col("id")).alias("content"))
    states = lambda told: {r.path: r.state for r in told.collect()}
    assert set(states(records.write_findings(docs, str(table), buckets=16)).values()) == {"written"}
    before = files(table)
    assert set(states(records.write_findings(docs, str(table), buckets=16)).values()) == {"unchanged"} and files(table) == before
    changed = docs.withColumn("content", F.when(F.col("path") == "7.md", "new").when(F.col("path") == "8.md", F.lit(None)).otherwise(F.col("content"))).where("path <> '9.md'")
    told = states(records.write_findings(changed, str(table), buckets=16))
    assert (told["7.md"], told["8.md"], told["10.md"]) == ("written", "failed", "unchanged")
    after = files(table)
    assert {p.split("bucket=")[1].split("/")[0] for p in before.keys() - after.keys()} == {p.split("bucket=")[1].split("/")[0] for p in after.keys() - before.keys()} and len(after.keys() - before.keys()) == 1
    now = {r.path: r.content for r in spark.read.parquet(str(table)).collect()}
    assert (now["7.md"], now["8.md"], now["9.md"], len(now)) == ("new", "c8", "c9", 200)


def test_sketches_of_halves_are_those_of_the_whole(spark):
    rows = spark.range(60_000).select(F.col("id").alias("scan_id"), (F.col("id") % 2).alias("day"), F.lit("k").alias("key"), F.lit(1).alias("sev_rank"))
    whole = occurrences.approximate_rollup(occurrences.scan_sketches(rows, ["key"])).first()
    halves = occurrences.scan_sketches(rows, ["day", "key"])
    merged = occurrences.approximate_rollup(halves).first()
    assert merged == whole and abs(whole.n_scans - 60_000) <= 4 * 0.0163 * 60_000 and whole.n_occurrences == 60_000
    assert occurrences.merge_sketches(halves, ["key"]).count() == 1


def sequential_match(edges):
    out, olds, news = [], set(), set()
    for o, n, s in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        if o not in olds and n not in news:
            out.append((o, n, s))
            olds.add(o)
            news.add(n)
    return sorted(out)


def test_a_long_rising_chain_is_the_sequential_loop(spark):
    edges = []
    for i in range(1000):
        edges += [(i, i, 0.5 + i / 4000), (i + 1, i, 0.5 + (i + 0.5) / 4000)]
    edges += [(5000 + i, 5000 + j, 0.9) for i in range(4) for j in range(4)]
    got = lookups.greedy_match(spark.createDataFrame(edges, "old_path long, new_path long, score double"), rounds=2)
    assert sorted(map(tuple, got.collect())) == sequential_match(edges)
    assert lookups.greedy_match(spark.createDataFrame([], "old_path long, new_path long, score double")).count() == 0


def test_random_edges_are_the_sequential_loop(spark):
    rng = random.Random(4)
    edges = [(f"g{g}o{i}", f"g{g}n{j}", rng.choice([0.6, 0.7, 0.8, 1.0])) for g in range(30) for i in range(7) for j in range(7) if rng.random() < 0.5]
    rows = [(o, n, s, s < 1) for o, n, s in edges]
    for rounds in (0, 1):
        got = lookups.greedy_match(spark.createDataFrame(rows, "old_path string, new_path string, score double, edited boolean"), rounds=max(rounds, 1)).collect()
        assert sorted((r.old_path, r.new_path, r.score) for r in got) == sequential_match(edges) and all(r.edited == (r.score < 1) for r in got)


def test_similarity_asks_new_against_old(spark, monkeypatch):
    monkeypatch.setattr(lookups, "PAIR_ROWS", 7)
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcİ ") for _ in range(rng.randrange(20, 40))) for _ in range(90)]
    df = spark.createDataFrame([("b", i, t) for i, t in enumerate(texts)], "block string, path int, text string")
    got = {(r.old_path, r.new_path): round(r.score, 9) for r in lookups.similar_pairs(df.where("path % 2 = 0"), df.where("path % 2 = 1")).collect()}
    flat = [" ".join(t.split()) for t in texts]
    want = {(i, j): SequenceMatcher(None, flat[j], flat[i]).ratio() for i in range(0, 90, 2) for j in range(1, 90, 2)}
    assert got == {k: round(v, 9) for k, v in want.items() if v >= 0.6} and len(got) > 30


def sequential_names(rows):
    taken, out, following = defaultdict(set), {}, {}
    for i, folder, name in sorted(rows):
        new, k = name, following.get((folder, name), 2)
        while new in taken[folder]:
            new, k = f"{name}-{k}", k + 1
        following[folder, name] = k
        taken[folder].add(new)
        out[i] = new
    return out


def test_names_are_those_of_the_sequential_loop(spark):
    rng = random.Random(6)
    pool = ["a", "a-2", "a-3", "a-2-2", "a-2-3", "a-02", "a-1", "b", "b-4", "a-2-2-2"]
    rows = [(i, rng.choice(["f", "g", None, ""]) or f"h{i % 9}", rng.choice(pool[: rng.choice([2, 4, 10])])) for i in range(600)]
    rows += [(1000 + i, None, rng.choice(pool)) for i in range(60)]
    rng.shuffle(rows)
    got = lookups.dedupe_names_exact(spark.createDataFrame(rows, "id int, folder string, name string"))
    assert {r.id: r.unique_name for r in got.collect()} == sequential_names([(i, f or "null", n) for i, f, n in rows])


def test_a_large_family_lies_in_many_tasks(spark):
    rows = spark.range(40_000).select("id", F.lit("f").alias("folder"), F.when(F.col("id") % 100 == 7, F.concat(F.lit("n-"), (F.col("id") * 7 % 30_000 + 2).cast("string"))).otherwise("n").alias("name"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = lookups.dedupe_names_exact(rows).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {r.id: r.unique_name for r in got} == sequential_names([(r.id, r.folder, r.name) for r in rows.collect()])
    assert len({r.task for r in got}) > 1
