"""Mixing, manifest and periodic runs against plain versions, with the odd cases of their input."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from findlake.llm import manifest, mixing, periodic, queries
from findlake.llm.ranges import running_totals

DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, taken int"


def odd_rows():
    rng = random.Random(5)
    rows = []
    for i in range(300):
        text = " ".join(rng.choice(["Ab", "cd", "Ef\n", "gh\t", "é漢", "x" * 40]) for _ in range(rng.choice([0, 1, 5, 9, 40])))
        rows.append((i * 7, text, rng.choice(["en", "fr", None, ""]) if i % 3 else "en", rng.choice(["a", "b", "Z", None, ""]), len(text), "clash", 1))
    rows += [(None, None, None, None, None, None, None), (None, "same", "en", "a", 4, "", 2), (7, "repeated", "en", "a", 8, "", 2), (7, "repeated", "en", "a", 8, "", 2), (14, "Other", "en", "a", 5, "", 2)]
    rows.append((9001, "long Words " * 40_000, "en", "Z", 440_000, "", 2))
    return rows


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def climb(nodes, path, steps):
    """Root of ``nodes`` and the path of the one at ``path``: (siblings before, siblings after) a level."""
    while len(nodes) > 1:
        at = path // 8 * 8
        steps.append((nodes[at:path], nodes[path + 1 : at + 8]))
        nodes, path = [sha(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)], path // 8
    return nodes[0]


def plain_manifest(rows):
    parts = defaultdict(list)
    for doc_id, text, lang, source, n_chars, *_ in rows:
        own = leaf(doc_id, source, lang, n_chars, text)
        bad = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0 and text is not None
        low = text.translate({c: c + 32 for c in range(65, 91)}) if bad else text
        parts[lang].append((doc_id is not None, doc_id or 0, own, leaf(doc_id, source, lang, n_chars, low)))
    names = sorted(parts, key=lambda v: (v is not None, (v or "").encode()))
    roots = [climb([x[2] for x in sorted(parts[name])], 0, []) for name in names]
    out = []
    for place, name in enumerate(names):
        ordered = sorted(parts[name])
        for at, (known, doc_id, own, given) in enumerate(ordered):
            steps = []
            climb([x[2] for x in ordered], at, steps)
            root = climb(roots, place, steps)
            folded = given
            for before, after in steps:
                folded = sha(*before, folded, *after)
            out.append((doc_id if known else None, own, roots[place], root, sha(*[d for b, a in steps for d in b + a]), folded, folded == root))
    return Counter(out)


def through_query(spark, tmp_path, rows, query):
    spark.createDataFrame(rows, DOCS).repartition(5).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    return query(spark, str(tmp_path)).collect()


def test_manifest_is_the_plain_tree(spark, tmp_path):
    rows = odd_rows()
    assert Counter(map(tuple, through_query(spark, tmp_path, rows, queries.op12_merkle_manifest))) == plain_manifest(rows)


@pytest.mark.parametrize("n", [0, 1, 8, 65])
def test_manifest_of_any_height(spark, tmp_path, n):
    rows = [(i, f"T{i}", "en", "s", 2, "", 0) for i in range(n)]
    assert Counter(map(tuple, through_query(spark, tmp_path, rows, queries.op12_merkle_manifest))) == (plain_manifest(rows) if n else Counter())


def test_other_strides_give_the_same_proofs(spark):
    leaves = spark.range(700).select((F.col("id") % 3).alias("g"), "id", F.sha2(F.col("id").cast("string"), 256).alias("h"))
    found = []
    for stride in (1, 2, 3):
        tree = manifest.build(leaves, "g", ["id"], "h", fanout=4, stride=stride)
        above = tree.tops.select("part", F.col("digest").alias("root"), F.array().cast("array<struct<left:array<string>,right:array<string>>>").alias("proof"))
        got = manifest.proofs(tree, above)
        assert got.where(manifest.fold(F.col("digest"), F.col("proof")) != F.col("root")).count() == 0
        found.append(sorted((r.id, r.root, str(r.proof)) for r in got.collect()))
    assert found[0] == found[1] == found[2] and len(found[0]) == 700


def test_running_totals_of_a_hot_group(spark):
    df = spark.range(2000).select(F.when(F.col("id") % 3 > 0, "hot").alias("g"), (F.col("id") * 7919 % 2003).alias("o"), (F.col("id") % 5).alias("a"))
    rows = df.collect()
    want = {}
    for g in ("hot", None):
        total = 0
        for r in sorted((r for r in rows if r.g == g), key=lambda r: r.o):
            want[r.o] = total
            total += r.a
    got = running_totals(df, ["g"], ["o"], F.col("a"), "before", "total").collect()
    assert {r.o: r.before for r in got} == want and len(got) == 2000


def test_mix_meets_its_targets(spark, tmp_path):
    rows = odd_rows()
    got = through_query(spark, tmp_path, rows, queries.op11_mix_sources)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, queries.op11_mix_sources(spark, str(tmp_path)).collect()), key=repr)
    size = {}
    for doc_id, text, _, source, *_ in rows:
        words = len((text or "").encode().split())
        size[source] = size.get(source, 0) + words
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter((r[0], r[3], len((r[1] or "").encode().split())) for r in rows)
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, open_ = {}, list(names)
    while True:  # reshare until none is above
        level = (1.5 * sum(size.values()) - sum(2 * size[s] for s in names if s not in open_)) / sum(weight[s] for s in open_)
        above = [s for s in open_ if level * weight[s] > 2 * size[s]]
        if not above:
            break
        open_ = [s for s in open_ if s not in above]
    for s in names:
        target[s] = level * weight[s] if s in open_ else 2.0 * size[s]
        own = [r for r in got if r.source == s]
        assert all(math.isclose(r.target, target[s]) and r.source_size == size[s] and 0 <= r.taken <= 2 * r.size for r in own)
        assert abs(sum(r.taken for r in own) - target[s]) <= 1


def test_mix_of_nothing_and_of_no_words(spark, tmp_path):
    assert through_query(spark, tmp_path, [], queries.op11_mix_sources) == []
    got = through_query(spark, tmp_path, [(1, None, None, None, None, None, None), (2, " ", "en", None, 1, "", 0)], queries.op11_mix_sources)
    assert [(r.size, r.target, r.taken) for r in got] == [(0, 0.0, 0)] * 2


def test_mix_prefers_by_weight_and_can_take_whole_documents_only(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit(10).cast("long").alias("size"), F.when(F.col("id") % 2 == 0, 3.0).otherwise(1.0).alias("weight"), F.lit("t").alias("tie"))
    targets = spark.createDataFrame([("s", 40_000, 10_004.0)], "source string, source_size long, target double")
    got = mixing.mix(docs, targets, cut_last=False).where("taken > 0").collect()
    assert len(got) == 1000 and all(r.taken == 10 for r in got)
    # the first quarter of a sample with weights 3 and 1 (keys: exponential of rates 3 and 1)
    t = next(t for t in np.linspace(0, 1, 10_001) if 2 - math.exp(-3 * t) - math.exp(-t) >= 0.5)
    assert abs(sum(r.doc_id % 2 == 0 for r in got) / 1000 - (1 - math.exp(-3 * t)) * 2) < 0.05


def plain_runs(words):
    out = []
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            n = j + q - i
            if n >= max(6, 4 * q) and not any(words[i : i + n - d] == words[i + d : i + n] for d in range(1, q)):
                out.append((i, n, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_are_those_of_all_periods():
    rng = random.Random(1)
    for _ in range(400):
        texts = []
        for _ in range(rng.randint(1, 4)):
            letters, words = rng.choice([1, 2, 2, 3, 5]), []
            while rng.random() < 0.8 and len(words) < 120:
                unit = [rng.randrange(letters) for _ in range(rng.randint(1, 9))]
                words += (unit * rng.randint(1, 7))[: rng.randint(1, 60)]
            texts.append([b"%d" % x for x in words])
        assert periodic._texts_runs(texts) == [plain_runs(w) for w in texts]


def test_wavelet_tree_finds_neighbours():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 300):
        values = rng.permutation(n)
        tree = periodic.WaveletTree(values)
        low = rng.integers(0, n, 50)
        high = rng.integers(low, n) + 1
        asked = values[rng.integers(low, high)]
        previous, following = tree.neighbours(low, high, asked)
        for a, b, x, p, f in zip(low, high, asked, previous, following, strict=True):
            own = sorted(values[a:b])
            k = own.index(x)
            assert p == (own[k - 1] if k else -1) and f == (own[k + 1] if k + 1 < len(own) else -1)


def test_run_query_is_the_plain_version(spark, tmp_path):
    rng = random.Random(9)
    rows = odd_rows() + [(10**6 + i, " ".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 90))), "en", "s", 1, "", 0) for i in range(200)]
    want = Counter()
    for doc_id, text, *_ in rows:
        words = (text or "").encode().split()
        n = len(words)
        h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        runs = [(0, n, 2)] if n == 80_000 and h % 10 else plain_runs(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
        kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        want[(doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha(lines), hashlib.sha256(kept).hexdigest())] += 1
    got = through_query(spark, tmp_path, rows, queries.op13_periodic_runs)
    assert Counter(map(tuple, got)) == want
    assert through_query(spark, tmp_path, [], queries.op13_periodic_runs) == []
