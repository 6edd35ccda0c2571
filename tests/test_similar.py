"""Bounds of similar texts: no pair of the threshold is lost, and few others are compared."""

import random
import time
from difflib import SequenceMatcher

from findlake.operators import lookups


def texts_of(rng):
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) + rng.choice(["", "", "", "X", "7", "é"]) for _ in range(400)]
    base = [" ".join(rng.choice(words) for _ in range(n)) for n in (3, 20, 30, 45, 60, 200, 300, 300, 400)]
    out = ["", "a", "aaaa", "ab" * 150, "ab" * 150 + "Q", "a" * 250, "Z" + "a" * 250]
    for text in base:
        for share in (0.0, 0.02, 0.05, 0.1, 0.3):
            out.append(" ".join(rng.choice(words) if rng.random() < share else w for w in text.split()))
            at = rng.randint(0, len(text))
            out.append(text[at:] + text[:at])
    return out


def test_bounds_lose_no_pair_and_leave_few():
    found = compared = near = pairs = 0
    for seed in range(2):
        texts = texts_of(random.Random(seed))
        hopeful = set(lookups._hopeful(texts, texts, 0.6))
        for i, old in enumerate(texts):
            for j, new in enumerate(texts):
                if SequenceMatcher(None, new, old).ratio() >= 0.6:
                    near += 1
                    found += (i, j) in hopeful
        compared, pairs = compared + len(hopeful), pairs + len(texts) ** 2
    assert found == near > 300
    assert compared < 0.4 * pairs


def test_copies_are_compared_once_and_every_pair_comes_out(spark):
    text = " ".join(texts_of(random.Random(5))[20:22])
    rows = spark.createDataFrame([("b", i, text if i % 3 else text + " more") for i in range(40)], "block string, path long, text string")
    got = lookups.similar_pairs(rows.where("path < 20"), rows.where("path >= 20")).collect()
    assert len({(r.old_path, r.new_path) for r in got}) == len(got) == 400
    assert {r.score for r in got if (r.old_path % 3 > 0) == (r.new_path % 3 > 0)} == {1.0}


def changed(rng, text, times):
    letters = list(text)
    for _ in range(times):
        at = rng.randrange(len(letters) + 1)
        letters[at : at + rng.randint(0, 4)] = rng.choices("ab .Xq", k=rng.randint(0, 3))
    return "".join(letters)


def test_ratio_is_the_one_of_the_walk_over_all_pairs_of_letters():
    rng = random.Random(7)
    texts = texts_of(rng)
    pairs = [(old, new) for old in texts for new in rng.sample(texts, 12)]
    for alphabet in ("ab", "abcdefgh", "abcdefghijklmnopqrstuvwxyz .,"):
        for n in (0, 1, 10, 150, 199, 200, 201, 500):
            for _ in range(20):
                old = "".join(rng.choices(alphabet, k=n)) + "".join(chr(rng.randint(200, 900)) for _ in range(rng.choice([0, 0, 60])))
                pairs.append((old, changed(rng, old, rng.randint(0, 12)) if rng.random() < 0.7 else "".join(rng.choices(alphabet, k=n))))
    for old, new in pairs:
        want, blocks = SequenceMatcher(None, new, old).ratio(), lookups._Blocks(old)
        assert blocks.ratio(new) == want
        assert blocks.ratio(new, 0.6) == want if want >= 0.6 else blocks.ratio(new, 0.6) < 0.6


def test_long_texts_are_compared_in_a_small_part_of_the_walks_time():
    rng = random.Random(3)
    words = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9))) + rng.choice(["", "", "", ".", "X", "7", "é", "q"]) for _ in range(2000)]
    old = " ".join(rng.choices(words, k=3000))
    new = " ".join(rng.choice(words) if rng.random() < 0.1 else w for w in old.split())
    began = time.process_time()
    want = SequenceMatcher(None, new, old).ratio()
    walk = time.process_time() - began
    began = time.process_time()
    assert lookups._Blocks(old).ratio(new) == want
    assert time.process_time() - began < walk / 5


def test_large_blocks_are_split_and_small_ones_share_tasks_without_loss(spark, monkeypatch):
    rng = random.Random(11)
    texts = texts_of(rng) + ["\tQ\x1cq  q", "Q q q"]
    rows = [(f"b{i % 7}" if i % 3 else "big", i, t) for i, t in enumerate(texts * 2)]
    df = spark.createDataFrame(rows, "block string, path long, text string")
    monkeypatch.setattr(lookups, "PAIR_ROWS", 5)
    monkeypatch.setattr(lookups, "PAIR_LETTERS", 4000)
    got = sorted((r.old_path, r.new_path, r.score) for r in lookups.similar_pairs(df.where("path % 2 = 0"), df.where("path % 2 = 1")).collect())
    flat = {i: (b, " ".join(t.split())) for b, i, t in rows}
    scores = [(i, j, SequenceMatcher(None, flat[j][1], flat[i][1]).ratio()) for i in flat for j in flat if i % 2 == 0 and j % 2 == 1 and flat[i][0] == flat[j][0]]
    assert got == sorted(x for x in scores if x[2] >= 0.6)
    assert len(got) > 40
