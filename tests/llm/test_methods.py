"""Operators against slow versions of their definitions, and the pipeline on planted rows."""

import os
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from findlake.llm import htmltext, langid, multiindex, quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
DATA = "/root/testdata/sf0.01"


def slow_bits(counts, order, word):
    """Interpolated Kneser-Ney by dictionaries of strings."""
    pad = langid.BOUNDARY * (order - 1)
    grams = Counter()
    for w, n in counts.items():
        padded = pad + w + langid.BOUNDARY
        for i in range(order - 1, len(padded)):
            grams[padded[i - order + 1 : i + 1]] += n
    tables, kinds = {order: grams}, {g[-1] for g in grams}
    for k in range(order - 1, 0, -1):
        tables[k] = Counter(g[1:] for g in tables[k + 1])
    floor = 1 / (len(kinds) + 1000)

    def prob(text, k):
        if k == 0:
            return floor
        table = tables[k]
        ones, twos = sum(v == 1 for v in table.values()), sum(v == 2 for v in table.values())
        discount = ones / (ones + 2 * twos) if ones and twos else 0.5
        context = text[-k:-1] if k > 1 else ""
        followers = [v for g, v in table.items() if g[:-1] == context]
        if not followers:
            return prob(text, k - 1)
        seen = table.get(text[-k:], 0)
        return max(seen - discount, 0) / sum(followers) + discount * len(followers) / sum(followers) * prob(text, k - 1)

    padded = pad + word + langid.BOUNDARY
    return -sum(np.log2(prob(padded[: i + 1], order)) for i in range(order - 1, len(padded)))


def test_character_models_are_interpolated_kneser_ney():
    counts = {"en": {"the": 5, "then": 2, "cat": 1, "that": 3, "a": 4}, "es": {"el": 4, "gato": 1, "la": 2, "las": 1}}
    models = langid.CharModels.fit(counts, 4)
    for word in ("the", "gat", "hat", "xyz", "a", "latthe"):
        assert np.allclose(models.bits([word])[0], [slow_bits(counts[lang], 4, word) for lang in models.languages], rtol=1e-5)


def test_quality_likelihood_and_gradient_are_those_of_all_labellings():
    rng = np.random.default_rng(0)
    lines, x, p = [3, 1, 2], rng.normal(size=(6, 4)), rng.normal(size=8) * 0.5
    evidence, weight = np.repeat([1.3, -1.3, 1.3], lines), np.repeat([0.5, 1.0, 2.0], lines)
    chains = quality.Chains(lines)

    def slow(p):
        out, at = -0.15 * p @ p, 0
        for n in lines:
            odds, t = x[at : at + n] @ p[:4], p[4:].reshape(2, 2)
            sums = np.zeros(2)
            for y in np.ndindex(*[2] * n):
                s = sum(o for o, v in zip(odds, y, strict=True) if v) + sum(t[a, b] for a, b in zip(y, y[1:], strict=False))
                q = sum(np.log(1 / (1 + np.exp(-evidence[at] if v else evidence[at]))) for v in y)
                sums += np.exp([s, s + q])
            out += weight[at] * np.log(sums[1] / sums[0])
            at += n
        return out

    value, gradient = quality.log_likelihood(p, x, chains, evidence, weight, 0.3)
    assert np.isclose(value, slow(p))
    assert np.allclose(gradient, [(slow(p + 1e-6 * e) - slow(p - 1e-6 * e)) / 2e-6 for e in np.eye(8)], atol=1e-5)


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<select><option>a<option>b</select>", "a\nb"), ("<noscript>n</noscript><object>o</object>", "no"), ("<svg><title>t</title><text>s</text></svg>", "s"), ("<math><mi>x</mi></math>", "x"),
        ("<input type=submit value=Go><input type=hidden value=H><input value=v>", "Gov"), ("<div style='visibility:hidden'>no<b style='visibility: visible'>yes</b></div>", "yes"),
        ("<table><tr><td rowspan=2>A<td>b<td>c<tr><td>d<td>ee</table>", "A | b | c\n  | d | ee"), ("<table><tr><td colspan='²'>a<td>b</table>", "a | b"), ("<table><tr><td rowspan=0>a<td>b<tr><td>c</table>", "a | b\n  | c"),
        ("<svg><desc/><text>t</text></svg>after", "tafter"), ("<svg/>a<div/>b", "a\nb"), ("<svg><foreignObject><style/>p{}</style>x", "x"), ("<table><tr style='visibility:hidden'><td>a<td style='visibility:visible'>b<tr><td>c<td>d</table>", "  | b\nc | d"),
        ("<style>.h, i{display:none}/* b{display:none} */</style><p class='x h'>no</p><i>no</i><b>yes</b>", "yes"), ("<style>p{display:none}p.a{display:block}</style><p>no<p class=a>yes", "yes"), ("<style>#a .c{display:none}</style><div id=a><p><b class=c>no</b></div><b class=c>yes</b>", "yes"),
        ("<style>div>.c{visibility:hidden}</style><div><b class=c>no</b><p><b class=c>yes</b></div>", "yes"), ("<style>@media print{p{display:none}}@media screen{b{display:none}}</style><p>yes</p><b>no</b>", "yes"), ("<style>b{display:none!important}i{display:none</style><b style='display:block'>no</b><i>no</i>x", "x"),
        ("<style>[hidden]{}.s{display:block}</style><p hidden class=s>yes</p><p hidden>no</p>", "yes"), ("<style media=print>p{display:none}</style><p>yes", "yes"), ("<style>a > b .c{display:none}</style><a><b><a><b><i><u class=c>no</u></i></b></a></b></a>x", "x"),
        ("<select><optgroup label=G><option label=L>no<option>a</select>", "G\nL\na"), ("<p style='white-space:pre'>a  b\n c</p>", "a  b\n c"), ("<p style='white-space:pre-line'>a  b\n c</p>", "a b\nc"), ("<style>.k{white-space:pre-wrap}</style><p class=k>a  b<i style='white-space:normal'>  c  d", "a  b c d"),
        ("<table><tr><td colspan=9999999999>a<td>b<tr><td>c</table>", "a | b\nc"), ("<table><tr hidden><td>no<td>no</tr><tr><td>a<td>b</table>", "a | b"),
        ("<dialog>no</dialog><p hidden>no</p>x", "x"), ("<ol start=3><li>a<li>b</ol>", "3. a\n4. b"),
    ],
)
def test_visible_text(html, text):
    assert htmltext.extract(html) == text


SHEET = ".n{display:none}.b{display:inline}.h{visibility:hidden}.v{visibility:visible}div .d{display:none}#i.b{display:none}"


def random_page(rng, depth, seen, shown, within, words):
    """Markup of a random element, and into ``words`` those of its own words that can be seen, worked out on the way down."""
    tag = rng.choice(["div", "span", "p", "section", "b", "em"] if "p" not in within else ["span", "b", "em"])
    marks = sorted({m for m in "nbhvd" if rng.random() < 0.15})
    named = rng.random() < 0.1
    said = rng.choice(["", "display:none", "display:block", "visibility:hidden", "visibility:visible;"], p=[0.8, 0.05, 0.05, 0.05, 0.05])
    # the heaviest rule on display first: own attribute, id with class, name with class, then the last of the classes
    display = said[8:] if said.startswith("display") else "none" if named and "b" in marks else "none" if "d" in marks and "div" in within else "inline" if "b" in marks else "none" if "n" in marks else "inline"
    visibility = said[11:].rstrip(";") if said.startswith("vis") else "visible" if "v" in marks else "hidden" if "h" in marks else ""
    shown, seen = shown and display != "none", visibility == "visible" if visibility else seen
    out = f"<{tag} class='{' '.join(marks)}'" + (" id=i" if named else "") + (f" style='{said}'" if said else "") + ">"
    for _ in range(rng.integers(1, 4)):
        word = f"w{rng.integers(10**9)}"
        out += f" {word} "
        if shown and seen:
            words.append(word)
        if depth:
            out += random_page(rng, depth - 1, seen, shown, within | {tag}, words)
    return out + f"</{tag}>"


def test_random_pages_show_what_a_walk_with_their_styles_shows():
    rng = np.random.default_rng(5)
    some = 0
    for _ in range(300):
        words = []
        page = random_page(rng, 3, True, True, frozenset(), words)
        assert htmltext.extract(f"<style>{SHEET}</style>{page}").split() == words
        some += bool(words)
    assert some > 150


def test_nested_tables_of_any_depth_keep_their_cells():
    out = htmltext.extract("<table><tr><td>a<td>b" * 60 + "<td>end</table>")
    assert out.count("a |") == 60 and "end" in out


@pytest.mark.parametrize("data", [DATA, "/root/testdata/check_s"])
def test_recall_of_the_registered_search(spark, data):
    from findlake.llm.queries import op8_multi_index

    if not os.path.exists(data):
        pytest.skip("needs the given tables")
    found = defaultdict(set)
    for r in op8_multi_index(spark, data).collect():
        found[r.query_id].add(r.vec_id)
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect() if r.embedding is not None]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hits = total = 0
    for q in np.flatnonzero(ids % 50 == 0):
        score = x @ x[q]
        score[q] = -9
        want = set(ids[np.lexsort((ids, -score))[:5]].tolist())
        hits, total = hits + len(want & found[int(ids[q])]), total + 5
    assert hits / total >= 0.9


def test_pipeline_on_planted_rows(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(3)
    vocabulary = {"en": [f"th{a}{b}" for a in "aeiou" for b in "nrst"], "es": [f"{a}l{b}" for a in "aeiou" for b in "aeo"]}
    text = lambda lang, n: " ".join(f"{rng.choice(vocabulary[lang])}{rng.choice(vocabulary[lang])}" for _ in range(n)).capitalize() + "."
    rows = [(i, text(lang, 60), lang) for i, lang in enumerate(["en", "es"] * 30)]
    rows += [(100 + i, "BUY!! NOW!! $$$ ### CLICK!! >>> " + text("en", 5), "en") for i in range(20)]
    shared = text("en", 55)
    rows += [(200, text("en", 40) + " " + shared, "en"), (201, shared + " " + text("en", 45), "en")]
    rows += [(300, rows[0][1], "en"), (None, rows[1][1], "es"), (301, None, None), (302, "", "en"), (303, "123 456", None)]
    spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], DOCS).withColumn("extra", F.lit(1)).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 100 or i >= 200)) for i in [*range(60), *range(100, 120), 200, 201]], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == {*range(60), 200, 201}
    by = defaultdict(list)
    for r in packed:
        by[r.sequence_id].append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
    # the shared passage stands once: 201 keeps its own words only
    lengths = {i: sum(r.length for r in packed if r.doc_id == i) for i in (200, 201)}
    assert lengths[201] < lengths[200] * 0.7


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
