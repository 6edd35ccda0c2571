"""Near copies of whole texts: every pair whose sets of word shingles have a Jaccard similarity of ``least`` or more.

Each set has a SimHash fingerprint. Fingerprints that the Gray-order index of ``simhash`` links are tried first, and those
whose whole sets reach the similarity are joined. At a similarity of 0.8 most fingerprints are farther apart than the index
can tell from chance, so an exact way takes the rest, and looks only at pairs that are not in one component by then.

For it a set is put into one order that holds for all sets (shingles that are common in a sample last, then by hash). Two sets
of similarity t or more share a shingle among the first ``n - ceil(t * n) + 1`` of each, so only these are shuffled and no
pair is missed; the places of the shingle in both sets bound what else they can share. Pairs that share one are tried by
their shapes, which bound what two sets have in common, and if those allow it on their whole sets: first each set with
leaders, which joins large groups of near copies at linear cost, then all pairs that are not in one component yet.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from findlake.llm.arrow import append_columns
from findlake.llm.components import connected_components
from findlake.llm.simhash import LIMIT, SEED, code_links, set_fingerprint, words_of
from findlake.llm.storage import discard, materialize, small_batches

SHINGLE = 5
LEAST = 0.8
#: The order is made on one text in so many; shingles that so many of these have come last. A bitmap of 4 MB, whatever the
#: corpus, knows them; it may take others for common, too. It decides what is shuffled, never which pairs are found.
SAMPLE_ONE_IN = 8
FEWEST = 3
COMMON_BITS = 1 << 25
PAIRS_AT_ONCE = 1 << 20


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The different hashes of a text's word shingles, sorted; a shorter text is one shingle, one without a word has none."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    width = min(shingle, len(words))
    grams = map(b" ".join, zip(*[words[i : len(words) - width + 1 + i] for i in range(width)], strict=True))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(g, SEED) for g in grams], np.uint64))


def shape(own: np.ndarray) -> bytes:
    """How many shingles of a set fall in each of so many buckets that they hold four on average; two bytes a bucket."""
    bits = max(4, len(own).bit_length() - 2)
    return np.bincount((own >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits).astype(np.uint16).tobytes() if len(own) else b""


def most_common(a: bytes, b: bytes) -> int:
    """At most so many shingles are in both sets, by their shapes; the finer one is brought to the other's buckets."""
    x, y = np.frombuffer(a, np.uint16).astype(np.int64), np.frombuffer(b, np.uint16).astype(np.int64)
    if len(x) > len(y):
        x, y = y, x
    return int(np.minimum(x, y.reshape(len(x), -1).sum(1)).sum()) if len(x) else 0


def row_key(docs: DataFrame) -> Column:
    """A key of each row by all its columns: only rows that are alike in all of them share it (by 64-bit hashes)."""
    columns = [docs[f"`{c}`"] for c in docs.columns]
    return F.xxhash64(*columns, *[c.isNull() for c in columns])


def _signed(number: int) -> int:
    return number - (1 << 64) if number >> 63 else number


def _common(texts: DataFrame, shingle: int) -> np.ndarray:
    """A bitmap of shingles (by the low bits of their hashes) that at least FEWEST texts of a fixed share of all have."""

    def make():
        return lambda values: ([shingle_set(t, shingle).view(np.int64) for t in values],)

    sampled = texts.where(F.pmod(F.xxhash64("row"), F.lit(SAMPLE_ONE_IN)) == 0)
    sets = append_columns(sampled, ["text"], [T.StructField("shingles", T.ArrayType(T.LongType()))], make)
    counted = sets.select(F.explode("shingles").alias("s")).groupBy("s").count().where(F.col("count") >= FEWEST)
    place = F.col("s").bitwiseAND(F.lit(COMMON_BITS - 1)) + 1
    maps = counted.select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = np.zeros(COMMON_BITS // 8, np.uint8)
    for bucket, bits in maps.collect():
        own = np.frombuffer(bytes(bits), np.uint8)
        out[(bucket - 1) * len(own) : bucket * len(own)] = own
    return out


def _prefixes(texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """``row, set, n, code, prefix, shape``: the hash of a text's set, its size and fingerprint, its first shingles in the common order, and its shape."""
    shared = texts.sparkSession.sparkContext.broadcast(_common(texts, shingle))

    def make():
        common = shared.value

        def one(text):
            own = shingle_set(text, shingle)
            outline = shape(own)
            name, code = (xxhash.xxh64_intdigest(own.tobytes()) if len(own) else 0), set_fingerprint(own)
            first = len(own) - math.ceil(least * len(own) - 1e-9) + 1 if len(own) else 0
            low = (own & np.uint64(COMMON_BITS - 1)).astype(np.int64)
            own = own[np.argsort(common[low >> 3] >> (low & 7).astype(np.uint8) & 1, kind="stable")]
            return _signed(name), len(own), _signed(code), own[:first].view(np.int64), outline

        return lambda values: tuple(zip(*map(one, values), strict=True))

    fields = [T.StructField("set", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("code", T.LongType()), T.StructField("prefix", T.ArrayType(T.LongType())), T.StructField("shape", T.BinaryType())]
    return append_columns(texts, ["text"], fields, make).select("row", "set", "n", "code", "prefix", "shape")


def fingerprint_pairs(printed: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``u, v``: sets that the Gray-order index brings together, a number of pairs linear in the sets.

    Of sets of one fingerprint each goes with the least; the least ones of two fingerprints that the index links go together.
    """
    prints = materialize(printed.where("n > 0").select("set", "code").distinct(), "prints")
    first = prints.groupBy("code").agg(F.min("set").alias("first"))
    same = prints.join(first, "code").select(F.col("set").alias("u"), F.col("first").alias("v"))
    ends = [first.select(F.col("code").alias(f"__{c}"), F.col("first").alias(c)) for c in ("u", "v")]
    across = code_links(prints, limit).withColumnsRenamed({"u": "__u", "v": "__v"}).join(ends[0], "__u").join(ends[1], "__v").select("u", "v")
    return same.unionByName(across).where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _by_key(rows: DataFrame, schema: str, each) -> DataFrame:
    """``each(run)`` for the rows (longs, the first column the key) of every key, a run whole and in the order of its columns."""
    names = [f.split()[0] for f in schema.split(", ")]
    width = len(rows.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def send(whole: np.ndarray) -> Iterator[pa.RecordBatch]:
            new = np.r_[True, whole[1:, 0] != whole[:-1, 0], True]
            cuts = np.flatnonzero(new)
            out: list[np.ndarray] = []
            size = 0
            for a, b in zip(cuts[:-1][np.diff(cuts) > 1].tolist(), cuts[1:][np.diff(cuts) > 1].tolist(), strict=True):
                for part in each(whole[a:b]):
                    out.append(part)
                    size += len(part)
                    if size >= PAIRS_AT_ONCE:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.concatenate(out).T], names=names)
                        out, size = [], 0
            if size:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.concatenate(out).T], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            part = np.stack([np.asarray(batch.column(i)) for i in range(width)], axis=1)
            if held and part[-1, 0] == held[0][0, 0]:
                held.append(part)
                continue
            whole = np.concatenate([*held, part]) if held else part
            last = int(np.searchsorted(whole[:, 0], whole[-1, 0]))
            if last:
                yield from send(whole[:last])
            held = [whole[last:]]
        if held:
            yield from send(np.concatenate(held))

    key = rows.columns[0]
    return rows.repartition(key).sortWithinPartitions(*rows.columns).mapInArrow(run, schema)


def _enough(common: int, n: int, m: int, least: float) -> bool:
    return common >= least * (n + m - common) - 1e-9


def _hopeful(pairs: DataFrame, printed: DataFrame, least: float) -> DataFrame:
    """The pairs ``u, v`` of sets whose shapes don't rule out the similarity ``least``."""
    shapes = printed.select("set", "n", "shape").dropDuplicates(["set"])
    both = pairs
    for end, n, own in (("u", "n", "a"), ("v", "m", "b")):
        both = both.join(shapes.select(F.col("set").alias(end), F.col("n").alias(n), F.col("shape").alias(own)), end)

    def make():
        return lambda a, b, n, m: ([_enough(most_common(x, y), i, j, least) for x, y, i, j in zip(a, b, n, m, strict=True)],)

    return append_columns(both, ["a", "b", "n", "m"], [T.StructField("hopeful", T.BooleanType())], make, keep=lambda values: values[0], drop_new=True).select("u", "v")


def _verified(pairs: DataFrame, texts: DataFrame, printed: DataFrame, shingle: int, least: float) -> DataFrame:
    """The pairs ``u, v`` of sets whose similarity reaches ``least``, written; only of those that shapes leave open whole sets are compared."""
    pairs = materialize(_hopeful(pairs, printed, least), "hopeful-pairs")
    ends = pairs.select(F.explode(F.array("u", "v")).alias("set")).distinct()
    holders = printed.join(ends, "set", "left_semi").groupBy("set").agg(F.min("row").alias("row"))
    found = texts.join(holders, "row").dropDuplicates(["set"])
    sets = materialize(append_columns(found, ["text"], [T.StructField("shingles", T.BinaryType())], lambda: lambda values: ([shingle_set(t, shingle).tobytes() for t in values],)).select("set", "shingles"), "shingle-sets")

    def make():
        def alike(a, b):
            a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            return _enough(len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b), least)

        return lambda left, right: ([alike(a, b) for a, b in zip(left, right, strict=True)],)

    both = pairs.join(sets.withColumnsRenamed({"set": "u", "shingles": "a"}), "u").join(sets.withColumnsRenamed({"set": "v", "shingles": "b"}), "v")
    linked = append_columns(both, ["a", "b"], [T.StructField("alike", T.BooleanType())], make, keep=lambda values: values[0], drop_new=True).select("u", "v")
    links = materialize(linked, "links")
    discard(pairs, sets)
    return links


def _leaders(least: float):
    """Of a run (shingle, n, set, cap): its rows with a leader each, a set with few rarer shingles, that sizes and caps allow; or the set itself.

    Of many edited copies of a text the text itself is near to all, and it is the one without shingles of its own.
    """

    def each(run: np.ndarray) -> Iterator[np.ndarray]:
        lead = run[:, 2].copy()
        left = np.lexsort((run[:, 2], run[:, 1], -run[:, 3]))
        while len(left) > 1:
            first, rest = run[left[0]], left[1:]
            n, cap = run[rest, 1], run[rest, 3]
            near = (cap >= first[1]) & (first[3] >= n) & (np.minimum(n, first[1]) >= least * np.maximum(n, first[1]) - 1e-9)
            lead[rest[near]] = first[2]
            left = rest[~near]
        yield np.column_stack([run, lead])

    return each


def _open_pairs(least: float):
    """Of a run (shingle, n, set, cap, component): the pairs in different components that sizes and caps allow."""

    def each(run: np.ndarray) -> Iterator[np.ndarray]:
        if (run[:, 4] == run[0, 4]).all():
            return
        ends = np.searchsorted(run[:, 1], np.minimum((run[:, 1] / least + 1e-9).astype(np.int64), run[:, 3]), side="right")
        for i in np.flatnonzero(ends > np.arange(len(run)) + 1).tolist():
            others = run[i + 1 : ends[i]]
            others = others[(others[:, 4] != run[i, 4]) & (others[:, 3] >= run[i, 1])][:, 2]
            if len(others):
                yield np.column_stack([np.minimum(others, run[i, 2]), np.maximum(others, run[i, 2])])

    return each


def _components(links: DataFrame) -> DataFrame:
    return connected_components(links).select(F.col("node").alias("set"), "component")


def _marked(shared: DataFrame, links: DataFrame) -> DataFrame:
    return shared.join(_components(links), "set", "left").withColumn("component", F.coalesce("component", "set"))


def _leader_pairs(shared: DataFrame, joined: DataFrame, only_one: bool) -> DataFrame:
    """The pairs ``u, v`` of a set and a leader that aren't in one component; with ``only_one`` the least such leader of a set."""
    led = shared.where("set <> leader").join(joined, "set", "left").join(joined.select(F.col("set").alias("leader"), F.col("component").alias("__c")), "leader", "left")
    led = led.where(F.coalesce("component", "set") != F.coalesce("__c", "leader")).select("set", "leader")
    if only_one:
        led = led.groupBy("set").agg(F.min("leader").alias("leader"))
    return led.select(F.least("set", "leader").alias("u"), F.greatest("set", "leader").alias("v")).distinct()


def near_copies(docs: DataFrame, row: Column, text_col: str = "text", shingle: int = SHINGLE, least: float = LEAST, limit: int = LIMIT) -> DataFrame:
    """``row, component`` for every row of ``docs`` (rows of one key have one text): components of the links of similarity ``least`` or more.

    Every link is one of whole sets; what the index over fingerprints brings together is tried first. Texts without a word are copies of each other. Shingles and sets are compared by 64-bit hashes.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(row.alias("row"), F.col(text_col).cast("string").alias("text"))
    printed = materialize(_prefixes(texts, shingle, least), "prefixes")
    sets = printed.select("set", "n", "prefix").dropDuplicates(["set"]).select("set", F.col("n").cast("long").alias("n"), F.posexplode("prefix").alias("pos", "shingle"))
    # Where two sets' first common shingle is this one they have no more in common than stands behind it, so a partner that is
    # similar enough has at most ``cap`` shingles. A pair with an earlier common shingle is met there.
    cap = F.floor((F.col("n") - F.col("pos")) * (1 + least) / least - F.col("n") + 1e-6).cast("long")
    dealt = sets.withColumn("cap", cap).where("cap > 0").select("shingle", "n", "set", "cap")
    shared = materialize(_by_key(dealt, "shingle long, n long, set long, cap long, leader long", _leaders(least)), "shared-shingles")
    # what the index links first; then one leader a set, which joins most of a large group; then the other leaders, then all
    # pairs, each time of those that aren't joined yet
    tried = materialize(fingerprint_pairs(printed, limit), "fingerprint-pairs")
    links = _verified(tried, texts, printed, shingle, least)
    for tag, only_one in (("leader", True), ("other-leader", False)):
        pairs = materialize(_leader_pairs(shared, _components(links), only_one).join(tried, ["u", "v"], "left_anti"), f"{tag}-pairs")
        tried = tried.unionByName(pairs)
        links = links.unionByName(_verified(pairs, texts, printed, shingle, least))
    marked = _marked(shared, links).select("shingle", "n", "set", "cap", "component")
    rest = materialize(_by_key(marked, "u long, v long", _open_pairs(least)).distinct().join(tried, ["u", "v"], "left_anti"), "open-pairs")
    discard(shared)
    more = _verified(rest, texts, printed, shingle, least)
    classes = connected_components(links.unionByName(more)).select(F.col("node").alias("set"), "component")
    return printed.select("row", "set").join(classes, "set", "left").select("row", F.coalesce("component", "set").alias("component"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """One row of each component, unchanged: that of the smallest id (null ids last), then of the smallest row key.

    Rows are told apart by all their columns, so null or repeated ids take no clean text away.
    """
    key = row_key(docs)
    found = near_copies(docs, key, text_col, shingle, least)
    ids = docs.select(key.alias("row"), docs[f"`{id_col}`"].alias("id"))
    order = F.struct(F.col("id").isNull(), F.col("id"), F.col("row"))
    kept = found.join(ids, "row").groupBy("component").agg(F.min(order)["row"].alias("__row")).select("__row")
    names = docs.columns
    return docs.withColumn("__key", key).join(kept, F.col("__key") == F.col("__row"), "left_semi").dropDuplicates(["__key"]).select(*[F.col(f"`{c}`") for c in names])
