"""Training-data operators against brute force, library results and round trips, with the odd cases of their input."""

import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from findlake.llm import bm25, bytebpe, htmltext, huffman, langid, multiindex, packing, quality, simhash, suffixes
from findlake.llm.wordbpe import WordEncoder

WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = [None, "", " ", "a", "Don't  stop\n\nnow ", "héé 漢字 İΣ\x1cx", "the cat sat on the mat " * 30, "ab" * 3000, "the cat sat on the mat " * 30]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


def test_word_encoder_is_the_library(spark):
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(WORDS), WordEncoder(WORDS, cache_words=3)
    for text in ODD[1:] + ["<|endoftext|> x", "½ 12 'll''s", "Ⱥ ﬁ ǅ"]:
        assert list(np.frombuffer(own.encode(text), "<u4")) == library.encode(text, add_special_tokens=False).ids


def test_huffman_round_trip(spark, tmp_path):
    docs = docs_of(spark, ODD).withColumn("ids", F.lit("clash"))
    tokens = huffman.encode_documents(docs, WORDS, end_id=2)
    huffman.write_ids(tokens, str(tmp_path / "a"), block_ids=100)
    got = {r.doc_id: r for r in huffman.read_ids(spark, str(tmp_path / "a")).collect()}
    start = 0
    for r in sorted(tokens.collect()):
        assert (got[r.doc_id].start, bytes(got[r.doc_id].ids)) == (start, bytes(r.ids))
        start += len(r.ids) // 4


def test_many_texts_are_encoded_together_as_the_library_encodes_each(monkeypatch):
    import random

    import public_tokenizers
    from findlake.llm import wordbpe

    rng = random.Random(5)
    letters = "aB c\n\t\x0b\x0c\r\x1c\x1f\x85\xa0\u1680\u2003\u2028\u202f\u205f\u3000\u200b\ufeffÉé's12.,_<|endoftext|>日😀İ"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(1500)] + [None, "", " ", "  a  ", "x " * 600]
    monkeypatch.setattr(wordbpe, "CHARS_AT_ONCE", 500)  # several runs, and a text that is one by itself
    encoder = wordbpe.WordEncoder(public_tokenizers.path("word_bpe_49k.json"), cache_words=50)
    want = [np.array(encoder.library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert encoder.encode_all(texts) == want
    assert encoder.encode_all([" ", None]) == [b"", b""] and encoder.encode_all([]) == []


def test_huffman_of_nothing(spark, tmp_path):
    huffman.write_ids(huffman.encode_documents(docs_of(spark, []), WORDS, 2), str(tmp_path / "e"))
    assert huffman.read_ids(spark, str(tmp_path / "e")).count() == 0


def test_code_lengths_are_bounded_and_complete():
    counts = np.array([2**i for i in range(30)])
    lengths = huffman.code_lengths(counts, 8)
    assert lengths.max() <= 8 and sum(2.0**-lengths) == 1
    assert sorted(huffman.code_lengths(np.array([5, 1, 1, 2]))) == [1, 2, 3, 3]


def test_packing_places_every_piece_without_gaps(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), int(n)) for i, n in enumerate(rng.integers(1, 100, 500))] + [(900, None), (901, 0)]
    for caps in (packing.Capacities(100, 100, 10000), packing.Capacities(100, 2, 10000), packing.Capacities(100, 100, 10000, rule="dot")):
        out = packing.best_fit_pack(spark.createDataFrame(rows, "doc_id long, length long").repartition(5), caps).toPandas()
        assert out[out.doc_id >= 900].sequence_id.isna().all()
        placed = out[out.doc_id < 900].sort_values(["sequence_id", "offset"])
        for _, g in placed.groupby("sequence_id"):
            assert list(g.offset) == list(g.length.cumsum() - g.length) and g.length.sum() <= 100 and len(g) <= caps.documents
        if caps.documents == 100 and caps.rule == "norm":
            bins = []  # piece by piece: longest first, each into the fullest bin that takes it
            for n in sorted((n for _, n in rows if n), reverse=True):
                fits = [i for i, r in enumerate(bins) if r >= n]
                if fits:
                    bins[min(fits, key=lambda i: bins[i])] -= n
                else:
                    bins.append(100 - n)
            assert placed.sequence_id.nunique() == len(bins)


def test_pieces(spark):
    rows = packing.cut_pieces(docs_of(spark, ODD), WORDS, end_id=1, longest=50).collect()
    encoder = WordEncoder(WORDS)
    for i, text in enumerate(ODD):
        data = encoder.encode(text) + struct.pack("<I", 1)
        mine = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == i)
        assert mine == [(k // 200, k // 4, len(data[k : k + 200]) // 4, zlib.crc32(data[k : k + 200])) for k in range(0, len(data), 200)]


def test_pieces_are_encoded_many_texts_at_a_time(spark, monkeypatch):
    import pyarrow as pa

    asked = []

    class Encoder:
        def encode_all(self, texts):
            asked.append(list(texts))
            return [b"" if not t else struct.pack(f"<{len(t)}I", *map(ord, t)) for t in texts]

    docs = docs_of(spark, ["ab"])
    monkeypatch.setattr(packing, "word_encoder", lambda path: Encoder())
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: run)
    run = packing.cut_pieces(docs, WORDS, end_id=1, longest=4)
    texts = ["abcdef", None, "", "xyz"] * 100
    rows = [r for b in run([pa.RecordBatch.from_arrays([pa.array(range(400)), pa.array(texts)], names=["doc_id", "text"])]) for r in b.to_pylist()]
    assert [len(a) for a in asked] == [256, 144]
    assert [(r["doc_id"], r["piece"], r["start"], r["length"]) for r in rows[:5]] == [(0, 0, 0, 4), (0, 1, 4, 3), (1, 0, 0, 1), (2, 0, 0, 1), (3, 0, 0, 4)]
    assert len(rows) == 500


def test_byte_bpe_is_tiktoken(spark):
    import tiktoken

    ranks = bytebpe.load_ranks(RANKS)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = bytebpe.ByteBPE(ranks, public_tokenizers.PATTERN)
    for text in ODD[1:] + ["x" * 5000, "  a\t\tb \n\n c  ", "I'll 12 34!?", "é" * 300]:
        ids = own.encode(text)
        assert list(np.frombuffer(ids, "<u4")) == library.encode_ordinary(text)
        assert own.decode(ids) == text.encode()


def test_simhash_components_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 6, dtype=np.int64)
    codes = sorted({int(b) ^ sum(1 << int(x) for x in rng.choice(63, k, replace=False)) for b in base for k in range(7) for _ in range(12)})
    parent = list(range(len(codes)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(codes):
        for j in range(i):
            if (a ^ codes[j]).bit_count() <= 3:
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    want = {}
    for i, a in enumerate(codes):
        want.setdefault(root(i), set()).add(a)
    for largest in (1000, 4):  # with and without divided blocks
        found = simhash.code_components(spark.createDataFrame([(c,) for c in codes], "code long"), largest_block=largest).collect()
        got = {}
        for r in found:
            got.setdefault(r.component, set()).add(r.code)
        assert sorted(map(sorted, got.values())) == sorted(sorted(s) for s in want.values() if len(s) > 1)


def test_simhash_of_odd_texts(spark):
    got = {r.doc_id: r for r in simhash.near_duplicates(docs_of(spark, ODD)).collect()}
    assert got[0].fingerprint == got[1].fingerprint == "0" * 16 and got[2].component_id == 0
    assert got[3].fingerprint == format(xxhash.xxh64_intdigest(b"a", 42), "016x")
    assert got[8].component_id == 6
    assert simhash.near_duplicates(docs_of(spark, [])).count() == 0


def test_repeated_passages_are_those_of_all_stretches(spark):
    rng = np.random.default_rng(4)
    word = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 5000, n))
    shared = word(70)
    texts = [word(200), word(90) + " " + shared + "\n" + word(40), shared, word(20) + " " + shared, None, "", "x " * 130, word(120) + " " + " ".join(shared.split()[:49])]
    first, where = {}, {}
    for i, t in enumerate(texts):
        w = (t or "").split()
        for a in range(len(w) - 49):
            where.setdefault(tuple(w[a : a + 50]), []).append((i, a))
    for k, v in where.items():
        first[k] = min(v)
    want = {}
    for k, v in where.items():
        for i, a in v:
            if (i, a) != first[k]:
                want.setdefault(i, set()).update(range(a, a + 50))
    got = {r.doc_id: {x for s in r.repeats for x in range(s.start, s.end)} for r in suffixes.repeated_passages(docs_of(spark, texts)).collect() if r.repeats}
    assert got == want
    kept = {r.doc_id: r for r in suffixes.remove_repeats(docs_of(spark, texts)).collect()}
    assert 2 not in kept and kept[1].text == texts[1] and kept[3].text.split() == texts[3].split()[:20] and kept[3].n_chars == len(kept[3].text)
    assert kept[4].text is None and kept[5].text == ""


def test_bm25_is_that_of_scoring_everything(spark):
    import math
    from collections import Counter

    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{min(int(x), 40)}" for x in rng.geometric(0.1, rng.integers(0, 60))) for _ in range(400)] + [None, ""]
    docs = docs_of(spark, texts)
    asked = [(1, "w1 w2 w2 w30"), (2, "w40"), (3, "none"), (4, None)]
    got = bm25.top_k(docs.repartition(3), spark.createDataFrame(asked, "query_id long, text string"), k=7).toPandas()
    counts = [Counter(bm25.terms_of(t)) for t in texts]
    lengths = [sum(c.values()) for c in counts]
    mean, df = sum(lengths) / len(texts), Counter(w for c in counts for w in c)
    for q, text in asked:
        scores = []
        for i, c in enumerate(counts):
            s = sum(n * math.log(1 + (len(texts) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * lengths[i] / mean)) for w, n in sorted(Counter(bm25.terms_of(text)).items()) if w in c)
            if s:
                scores.append((-s, i))
        mine = got[got.query_id == q].sort_values("rank")
        assert list(mine.doc_id) == [i for _, i in sorted(scores)[:7]]
        assert np.allclose(mine.score, [-s for s, _ in sorted(scores)[:7]])


def test_bm25_frequent_terms_come_by_rows_and_change_no_score(monkeypatch):
    from collections import Counter

    rng = np.random.default_rng(23)
    n, rule = 700, bm25.Bm25()
    held = [dict(Counter((rng.zipf(1.3, 60) % 5000).tolist())) for _ in range(n)]
    lengths = np.array([sum(h.values()) for h in held])
    held[0], lengths[0] = {}, 0  # an empty text
    mean = lengths.mean()
    terms = sorted(set().union(*held))
    of = {t: [(i, h[t]) for i, h in enumerate(held) if t in h] for t in terms}
    flat = [x for t in terms for x in of[t]]
    row = {"ids": np.arange(n) * 3, "lengths": lengths.astype(np.int32), "terms": np.array(terms, np.uint64), "ends": np.cumsum([len(of[t]) for t in terms]).astype(np.int32)}
    row |= {"ords": np.array([i for i, _ in flat], np.uint16), "freqs": np.array([f for _, f in flat], np.int32)}
    row = {k: v.tobytes() for k, v in row.items()}
    asked = [sorted(held[i]) + [10_000 + i] for i in (0, 5, 17, 400, 699)] + [[], [terms[0]], [10_000], terms[-40:]]
    weights = [np.array([rule.idf(n, np.float64(len(of.get(t, [])))) for t in q]) for q in asked]
    begins = np.r_[0, np.cumsum([len(q) for q in asked])]
    want = []
    for q, w in zip(asked, weights, strict=True):
        scores = [round(sum(x * rule.gain(held[i][t], lengths[i], mean) for t, x in zip(q, w, strict=True) if t in held[i]), 6) for i in range(n)]
        want.append(sorted((-s, i * 3) for i, s in enumerate(scores) if s > 0 and i != 5)[:10])
    for most in (2048, 3, 0):  # all frequent terms by rows, some, none
        monkeypatch.setattr(bm25, "MOST_ROWS", most)
        shard = bm25.Shard(row, mean, rule)
        assert len(shard.rows) == min(most, sum(len(x) >= 32 for x in of.values())) and (most < 2048 or len(shard.rows) > 3)
        best = [bm25.Best(10) for _ in asked]
        shard.search(begins, np.array([t for q in asked for t in q], np.uint64), np.concatenate(weights), best, [15] * len(asked))
        for b, w in zip(best, want, strict=True):
            assert sorted(zip((-b.scores).tolist(), b.ids.tolist(), strict=True)) == w


def test_bm25_searches_all_queries_of_a_shard_together(monkeypatch):
    import sys
    from collections import Counter

    rng = np.random.default_rng(31)
    rule, n = bm25.Bm25(), 600
    # the second shard repeats texts of the first; its last blocks hold other words
    held = [dict(Counter((rng.zipf(1.3, 50) % 3000).tolist())) for _ in range(n)]
    held += [held[i] for i in range(300)] + [dict(Counter((5000 + rng.zipf(1.3, 50) % 40).tolist())) for _ in range(300)]
    ids, lengths = np.r_[rng.permutation(n), np.arange(n, 2 * n)], np.array([sum(h.values()) for h in held])
    mean, df = lengths.mean(), Counter(t for h in held for t in h)
    asked = [sorted(held[i]) for i in range(200)] + [[], [5001], [9999]]
    weights = [np.array([rule.idf(2 * n, np.float64(df[t])) for t in q]) for q in asked]
    begins, own = np.r_[0, np.cumsum([len(q) for q in asked])], ids[:200].tolist() + [5, 6, 7]

    def row(first):
        part = held[first : first + n]
        terms = sorted(set().union(*part))
        of = [[(i, h[t]) for i, h in enumerate(part) if t in h] for t in terms]
        out = {"ids": ids[first : first + n], "lengths": lengths[first : first + n].astype(np.int32), "terms": np.array(terms, np.uint64), "ends": np.cumsum([len(x) for x in of]).astype(np.int32)}
        out |= {"ords": np.array([i for x in of for i, _ in x], np.uint16), "freqs": np.array([f for x in of for _, f in x], np.int32)}
        return {k: v.tobytes() for k, v in out.items()}

    want = []
    for q, w, without in zip(asked, weights, own, strict=True):
        scores = [round(sum(x * rule.gain(h[t], size, mean) for t, x in zip(q, w, strict=True) if t in h), 6) for h, size in zip(held, lengths, strict=True)]
        want.append(sorted((-s, i) for s, i in zip(scores, ids.tolist(), strict=True) if s > 0 and i != without)[:10])
    calls = [0]
    for gain, at_once in ((0, 1), (384, 5000), (10**9, 1 << 16)):  # no rows, some rows, all rows in the product
        monkeypatch.setattr(bm25, "PRODUCT_GAIN", gain, raising=False)
        monkeypatch.setattr(bm25, "POSTINGS_AT_ONCE", at_once, raising=False)
        best = [bm25.Best(10) for _ in asked]
        for first in (0, n):
            shard, calls[0] = bm25.Shard(row(first), mean, rule), 0
            sys.setprofile(lambda _, event, __: calls.__setitem__(0, calls[0] + event.endswith("call")))
            try:
                shard.search(begins, np.array([t for q in asked for t in q], np.uint64), np.concatenate(weights), best, own)
            finally:
                sys.setprofile(None)
        for b, w in zip(best, want, strict=True):
            assert sorted(zip((-b.scores).tolist(), b.ids.tolist(), strict=True)) == w
    assert calls[0] < 25 * len(asked)  # once there are good scores, a query by itself costs a merge at most


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    rows = [(i, [float(v) for v in x[i]]) for i in range(300)] + [(300 + i, [float(v) for v in x[0]]) for i in range(20)] + [(400, None), (450, [0.0] * 8), (500, [float("nan")] * 8)]
    df = spark.createDataFrame(rows, T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType()))]))
    got = multiindex.search(df, F.col("vec_id") % 50 == 0, settings=multiindex.IndexSettings(centroids=4, share=1.0)).toPandas()
    assert list(got[got.query_id == 0].sort_values("rank").vec_id) == [300, 301, 302, 303, 304]
    assert not set(got.query_id) & {400, 450, 500}
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = unit @ unit[50]
    s[50] = -9
    mine = got[got.query_id == 50].sort_values("rank")
    assert np.allclose(mine.score.iloc[0], s.max())


def test_neighbours_of_mixed_lengths_and_cut_parts(spark):
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(300)] + [(1000 + i, [1.0] * (i % 5 + 1)) for i in range(40)] + [(2000 + i, rows_of_one) for i, rows_of_one in enumerate([[1.0, 2.0, 3.0, 4.0, 5.0, 6.0]] * 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    every = multiindex.IndexSettings(centroids=5, share=1.0, part=16, query_part=7)
    got = {}
    for r in multiindex.search(df, F.col("vec_id") % 10 == 0, 5, every).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    kept = [(i, np.array(v) / np.linalg.norm(v)) for i, v in rows if len(v) == 6]
    for i, v in kept:
        if i % 10 == 0:
            want = sorted(((-round(float(v @ w), 12), j) for j, w in kept if j != i))[:5]
            assert [j for j, _ in got[i]] == [j for _, j in want]
            assert np.allclose([s for _, s in got[i]], [-s for s, _ in want])
    assert len(got) == sum(i % 10 == 0 for i, _ in kept)


def test_walk_takes_cells_in_order_of_summed_distance():
    rng = np.random.default_rng(3)
    book = multiindex.Codebook(rng.normal(size=(7, 2)), rng.normal(size=(5, 2)))
    for wanted in (0, 1, 9, 40, 10**6):
        sizes, unit = rng.integers(0, 4, 35).tolist(), rng.normal(size=4)
        far = (((book.left - unit[:2]) ** 2).sum(1)[:, None] + ((book.right - unit[2:]) ** 2).sum(1)).ravel()
        want, held = set(), 0
        for cell in np.argsort(far).tolist():
            if held >= wanted:
                break
            want.add(cell)
            held += sizes[cell]
        assert set(np.flatnonzero(book.walk(unit, sizes, wanted).ravel()).tolist()) == want


def test_html(spark):
    page = "<title>t</title><p>A &amp; b<p>C<ul><li>x<li>y<ol><li>z</ol></ul><table><tr><td>1<td>long<tr><td>22<td>b</table><div style='display:none'>no</div><script>no</script><pre>k  p\n q</pre>e<br>f"
    assert htmltext.extract(page) == "A & b\n\nC\n\n- x\n- y\n  1. z\n\n1  | long\n22 | b\n\nk  p\n q\n\ne\nf"
    assert [htmltext.extract(p) for p in (None, "", "<p>a<b", "<div>" * 3000 + "deep")] == ["", "", "a<b", "deep"]
    assert htmltext.extract_text(spark.createDataFrame([], "html string")).count() == 0
    assert [r.text for r in htmltext.extract_text(spark.createDataFrame([("<p>a",), ("<p>a",)], "html string")).collect()] == ["a", "a"]
    df = spark.createDataFrame([(1, page, "clash"), (2, None, None)], "page_id long, html string, TEXT string")
    assert {r.page_id: bool(r.text) for r in htmltext.extract_text(df).collect()} == {1: True, 2: False}


def test_language_models(spark):
    a, b = ["the cat and the dog were in the house"] * 5, ["el gato y el perro estaban en la casa"] * 5
    rows = [(i, t, "en" if i < 40 else "es", "s", 1) for i, t in enumerate([f"{x} number {i}" for i in range(8) for x in a] + [f"{x} numero {i}" for i in range(8) for x in b])]
    docs = spark.createDataFrame(rows, DOCS)
    models = langid.fit(docs, F.lit(True))
    probe = docs_of(spark, ["the dog", "la casa del perro", None, "", "123 ..."])
    got = {r.doc_id: r for r in langid.predict(probe, models).collect()}
    assert (got[0].lang_pred, got[1].lang_pred, got[2].lang_pred, got[3].lang_pred, got[4].lang_pred) == ("en", "es", "und", "und", "und")
    assert {r.doc_id for r in langid.keep_accepted(probe, models).collect()} == {0, 1}
    assert all(0 <= r.score <= 1 for r in got.values())


def test_quality_marginals_are_those_of_all_labellings():
    odds, t = np.array([0.3, -1.0, 2.0]), np.array([[0.5, -0.2], [0.1, 0.4]])
    weight, good = 0.0, np.zeros(3)
    for y in np.ndindex(2, 2, 2):
        w = np.exp(sum(o for o, v in zip(odds, y, strict=True) if v) + sum(t[a, b] for a, b in zip(y, y[1:], strict=False)))
        weight, good = weight + w, good + w * np.array(y)
    assert np.allclose(quality.marginals(odds, t), good / weight)


def test_quality_learns_and_takes_odd_texts(spark):
    texts = [f"This is a plain sentence about thing {i}. It goes on for a while." if i % 2 else f"BUY!! NOW!! {i} $$$ ### CLICK!! HERE!!" for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    field = quality.fit(docs_of(spark, texts), labels, F.lit(True))
    got = {r.doc_id: r.score for r in quality.score(docs_of(spark, texts[:4] + [None, "", "\n \n"]), field).collect()}
    assert got[1] > 0.5 > got[0] and got[4] == got[5] == got[6] == 0.0


@pytest.mark.parametrize("name", ["op1_simhash", "op10_suffix_dedup", "op5_language_id"])
def test_registered(name):
    from findlake.llm.queries import QUERIES

    assert name in QUERIES
