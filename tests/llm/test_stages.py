"""Stages and operators on planted cases: near copies, rows without an id of their own, languages, queries."""

import os
import re
import tempfile
import time
from glob import glob

import numpy as np
import xxhash
from pyspark.sql import functions as F

from findlake.llm import bm25, langid, nearcopies, storage, suffixes
from findlake.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


def words(rng, n, of=100_000):
    return [f"w{x}" for x in rng.integers(0, of, n)]


def similarity(a, b):
    a, b = (set(nearcopies.shingle_set(t).tolist()) for t in (a, b))
    return len(a & b) / len(a | b)


def test_near_duplicate_stage_finds_all_links_of_similarity(spark):
    import corpus_pipeline

    rng = np.random.default_rng(7)
    texts = []
    for edits in (1, 2, 3, 4, 6, 8, 10):  # of 400 words: similarity from 0.97 to below 0.8
        for _ in range(3):
            base = words(rng, 400)
            near = list(base)
            for at in rng.choice(400, edits, replace=False):
                near[at] = f"new{rng.integers(1 << 30)}"
            texts += [" ".join(base), " ".join(near)]
    line = " ".join(words(rng, 30)) + "\n"
    texts += [line * 40 + " ".join(words(rng, 60)) for _ in range(4)]  # different bodies under one repeated line
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if similarity(texts[i], texts[j]) >= 0.8:
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    want = {root(i) for i in range(len(texts))}
    assert len(want) == len(texts) - 18  # 8 edits are the most that stay above 0.8
    kept = corpus_pipeline.near_duplicates(spark, docs_of(spark, enumerate(texts)), "")
    assert {r.doc_id for r in kept.collect()} == want


def test_near_duplicate_stage_asks_the_index_over_fingerprints_first(spark, monkeypatch):
    import corpus_pipeline
    from findlake.llm import simhash

    rng = np.random.default_rng(17)
    texts = [" ".join(words(rng, 300)) for _ in range(20)]
    texts += [f"{t} new{i}" for i, t in enumerate(texts[:12])]  # one shingle more
    texts += [texts[0], ""]
    sets = [nearcopies.shingle_set(t) for t in texts]
    codes = [simhash.set_fingerprint(s) for s in sets]
    slow = [sum(1 << b for b in range(64) if sum(int(h) >> b & 1 for h in s) * 2 > len(s)) for s in sets]
    assert codes == slow
    near = {(i, j) for j in range(32) for i in range(j) if (codes[i] ^ codes[j]).bit_count() <= simhash.LIMIT}
    assert len(near) >= 8
    place = {np.uint64(xxhash.xxh64_intdigest(x.tobytes())).astype(np.int64).item(): i for i, x in enumerate(sets[:32])}
    ask, seen = nearcopies.fingerprint_pairs, []

    def asked(printed, limit=simhash.LIMIT):
        found = ask(printed, limit)
        seen.extend(tuple(sorted((place[u], place[v]))) for u, v in found.collect())
        return found

    docs = docs_of(spark, enumerate(texts))
    monkeypatch.setattr(nearcopies, "fingerprint_pairs", asked)
    # with nothing else to try, the links are those of the index that reach the similarity
    monkeypatch.setattr(nearcopies, "_leader_pairs", lambda shared, joined, only_one: shared.sparkSession.createDataFrame([], "u long, v long"))
    monkeypatch.setattr(nearcopies, "_open_pairs", lambda least: lambda run: iter(()))
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert set(seen) == near
    linked = {j for i, j in near if similarity(texts[i], texts[j]) >= 0.8}
    assert linked and kept == set(range(34)) - linked - {32}


def test_near_duplicate_stage_keeps_clean_texts_of_null_and_repeated_ids(spark):
    import corpus_pipeline

    rng = np.random.default_rng(8)
    a, b, c, d = (" ".join(words(rng, 80)) for _ in range(4))
    rows = [(None, a), (None, b), (5, c), (5, d), (5, c), (None, c), (9, "")]
    kept = corpus_pipeline.near_duplicates(spark, docs_of(spark, rows), "")
    assert sorted((r.doc_id or -1, r.text) for r in kept.collect()) == sorted([(-1, a), (-1, b), (5, c), (5, d), (9, "")])


def test_passages_of_null_and_repeated_ids_are_told_apart(spark):
    rng = np.random.default_rng(9)
    shared = " ".join(words(rng, 60))
    for doc in (None, 5):
        bodies = [" ".join(words(rng, n)) for n in (30, 70, 10)]
        rows = [(doc, f"{shared} {body}") for body in bodies]  # one passage at the same offset of three texts
        kept = [r.text for r in suffixes.remove_repeats(docs_of(spark, rows)).collect()]
        assert sorted(len(t.split()) for t in kept) in (sorted(n + 60 * (n == first) for n in (30, 70, 10)) for first in (30, 70, 10))
        assert sorted(" ".join(t.split()[-10:]) for t in kept) == sorted(" ".join(b.split()[-10:]) for b in bodies)


def test_junk_in_the_calibration_sample_lets_no_junk_pass(spark):
    rng = np.random.default_rng(10)
    vocabulary = {"en": "the house was near a river and people walked along its quiet banks".split(), "es": "la casa estaba cerca del agua donde los vecinos paseaban cada tarde".split()}
    junk = lambda n: " ".join("".join(rng.choice(list("qxzjkvwphg"), 7)) for _ in range(n))
    rows = [(i, " ".join(rng.choice(vocabulary[lang], 40)), lang, "s", 1) for i, lang in enumerate(["en", "es"] * 150)]
    rows += [(1000 + i, junk(40), "en", "s", 1) for i in range(15)] + [(2000, "lone words", "xx", "s", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    models = langid.fit(docs, F.lit(True))
    assert np.isfinite(models.center).all() and np.isfinite(models.spread).all()
    probe = [(i, " ".join(rng.choice(vocabulary["en"], n))) for i, n in enumerate([3, 10, 100] * 20)] + [(100 + i, "".join(rng.choice(list("aeothrsni"), 200))) for i in range(20)]
    kept = {r.doc_id for r in langid.keep_accepted(docs_of(spark, probe), models).collect()}
    assert kept == set(range(60))


def test_every_label_is_learned_from_whole_words(spark):
    rng = np.random.default_rng(11)
    letters = [chr(0x4E00 + i) for i in range(700)]
    text = lambda i: " ".join("".join(rng.choice(letters[i * 10 : i * 10 + 10], 80)) for _ in range(6))
    docs = spark.createDataFrame([(i * 10 + k, text(i), f"l{i:02}", "s", 1) for i in range(70) for k in range(8)], DOCS)
    models = langid.fit(docs, F.lit(True))
    assert models.languages == [f"l{i:02}" for i in range(70)]
    got = {r.doc_id: r.lang_pred for r in langid.predict(docs_of(spark, [(i, text(i)) for i in range(70)]), models).collect()}
    assert got == {i: f"l{i:02}" for i in range(70)}


def test_long_words_teach_their_ends(spark):
    docs = docs_of(spark, [(i, "a" * 64 + "bcd" * 10 + chr(0x100 + i % 5)) for i in range(40)])
    models = langid.fit(docs, F.lit(True))
    known, unknown = models.bits(["bcdbcd", "xyzxyz"])[:, 0]
    assert known < unknown / 2


def test_op9_asks_every_fiftieth_document_of_all_others(spark, tmp_path):
    from findlake.llm.queries import op9_bm25_top_k

    rng = np.random.default_rng(12)
    texts = [" ".join(f"w{x}" for x in rng.geometric(0.02, rng.integers(1, 80))) for _ in range(260)]
    docs_of(spark, enumerate(texts)).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = op9_bm25_top_k(spark, str(tmp_path)).toPandas()
    assert set(got.query_id) == {0, 50, 100, 150, 200, 250} and not (got.query_id == got.doc_id).any()
    counts = [{w: t.split().count(w) for w in set(t.split())} for t in texts]
    lengths = [len(t.split()) for t in texts]
    df, mean, rule = {w: sum(w in c for c in counts) for w in set().union(*counts)}, np.mean(lengths), bm25.Bm25()
    for q in (0, 50, 250):
        scores = [sum(n * rule.idf(260, df[w]) * rule.gain(c[w], lengths[i], mean) for w, n in sorted(counts[q].items()) if w in c) for i, c in enumerate(counts)]
        scores[q] = 0
        mine = got[got.query_id == q].sort_values("rank")
        assert np.allclose(mine.score, sorted(scores, reverse=True)[:10]) and np.allclose(mine.score, [scores[i] for i in mine.doc_id])


def _shuffle_files(spark) -> set[str]:
    tops = os.environ.get("SPARK_LOCAL_DIRS", spark.conf.get("spark.local.dir", tempfile.gettempdir())).split(",")
    return {f for top in tops for f in glob(f"{top}/**/blockmgr-*/*/shuffle_*.data", recursive=True)}


def _scratch_tables(spark) -> set[str]:
    """Folders with part files, checkpoints included, below the shared folder."""
    return {d for d, _, names in os.walk(storage.shared_dir(spark).removeprefix("file://")) if any(n.startswith("part-") for n in names)}


def test_shuffle_files_go_when_their_table_is_written(spark):
    before, setting = _shuffle_files(spark), spark.conf.get(storage.CLEANUP_SETTING)
    table = storage.materialize(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counted")
    for _ in range(50):
        if not (left := _shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    assert not left
    assert spark.conf.get(storage.CLEANUP_SETTING) == setting
    assert sorted(r["count"] for r in table.collect()) == [142, 143, 143, 143, 143, 143, 143]


def test_components_keep_no_table_but_the_last(spark):
    before = _scratch_tables(spark)
    found = connected_components(spark.range(60).where("id % 20 < 19").select(F.col("id").alias("u"), (F.col("id") + 1).alias("v")))
    assert len(_scratch_tables(spark) - before) == 1
    assert {r.node: r.component for r in found.collect()} == {i: i // 20 * 20 for i in range(60)}


def test_near_duplicate_stage_leaves_no_whole_sets_behind(spark):
    import corpus_pipeline

    rng = np.random.default_rng(18)
    text = " ".join(words(rng, 120))
    before = _scratch_tables(spark)
    kept = corpus_pipeline.near_duplicates(spark, docs_of(spark, [(i, f"{text} x{i}") for i in range(6)]), "")
    assert [r.doc_id for r in kept.collect()] == [0]
    assert not [d for d in _scratch_tables(spark) - before if re.search("/(shingle-sets|hopeful-pairs|shared-shingles)-", d)]
