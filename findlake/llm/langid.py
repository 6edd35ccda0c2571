"""Language identification by interpolated Kneser-Ney character models.

A model gives the probability of the characters of lower-cased words, each between word boundaries. The n-grams
of every order lie in sorted arrays of 64-bit hashes, with columns of interpolated probabilities and of back-off
weights for each language, both in bits, so one binary search serves the languages of a group. The language with the lowest cross-entropy a
character wins; a text is rejected where that entropy is far above the median of held-back training texts of the language.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from findlake.llm.arrow import append_columns
from findlake.llm.storage import small_batches
from findlake.llm.warm import keep_warm

UNKNOWN = "und"
BOUNDARY = "\x02"
WORDS = re.compile(r"[^\W\d_]+")
CACHE_WORDS = 150_000
LONGEST_CACHED = 40
#: Words whose bits are added up at once (CACHE_WORDS must be more than twice as many), and characters looked up at once.
WORDS_AT_ONCE = 1 << 15
CHARS_AT_ONCE = 20_000
MULTIPLIER = 0x9E3779B97F4A7C15
#: Bits of a hash that number the buckets in which a label's ids are counted.
BUCKET_BITS = 14
#: Languages whose models share arrays.
GROUP = 4
#: Acceptance: the length whose texts scatter by the square root of two, the spreads that are allowed, the least
#: allowance in bits a character, and the calibration texts below which a label takes the pooled figures.
SHORT_CHARS = 50
SPREADS = 8.0
LEAST_ALLOWANCE = 2.0
FEWEST_TEXTS = 20

RESULT_FIELDS = [
    T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
    T.StructField("cross_entropy", T.DoubleType()), T.StructField("accepted", T.BooleanType()),
]


def words_of(text: str | None) -> list[str]:
    return WORDS.findall(text.lower()) if text else []


@dataclass(frozen=True)
class FitLimits:
    """Bounds of the sample that a model is fitted on, and so of the model's size."""

    #: labelled documents a language, those with the smallest hash of their id
    docs: int = 1500
    order: int = 5
    #: of the sampled documents, one in so many only calibrates
    calibrate_one_in: int = 5


def _characters(words: list[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The code points of padded words in a row, the places of the predicted characters, and the number of them in each word."""
    pad = BOUNDARY * (order - 1)
    codes = np.frombuffer("".join([pad + w + BOUNDARY for w in words]).encode("utf-32-le"), "<u4")
    counts = np.array([len(w) + 1 for w in words])
    at = np.arange(int(counts.sum())) + np.repeat(np.arange(1, len(words) + 1) * (order - 1), counts)
    return codes, at, counts


def _suffix_hashes(codes: np.ndarray, order: int) -> list[np.ndarray]:
    """At every place the hashes of the last 0, 1, ... ``order`` code points: polynomials in a 64-bit multiplier."""
    wide, factor = codes.astype(np.uint64), MULTIPLIER
    out = [np.zeros(len(codes), np.uint64)]
    for k in range(order):
        longer = out[-1].copy()
        longer[k:] += wide[: len(wide) - k] * np.uint64(factor)
        out.append(longer)
        factor = factor * MULTIPLIER & 0xFFFFFFFFFFFFFFFF
    return out


class CharModels:
    """One Kneser-Ney model a language over common sorted hash arrays."""

    def __init__(self, languages: list[str], order: int, grams: list[np.ndarray], gram_bits: list[np.ndarray], contexts: list[np.ndarray], context_bits: list[np.ndarray], unseen: np.ndarray):
        self.languages, self.order, self.unseen = languages, order, unseen
        self.grams, self.gram_bits, self.contexts, self.context_bits = grams, gram_bits, contexts, context_bits

    @classmethod
    def fit(cls, counts: dict[str, dict[str, int]], order: int) -> CharModels:
        """From the counts of words of each language.

        A gram's column holds the bits of its interpolated probability, lower orders included, so that a character costs
        one look-up where its longest gram is known; a context's column holds the bits that backing off from it costs.
        """
        languages = sorted(counts)
        tables = [cls._estimate(counts[lang], order) for lang in languages]
        floor = np.array([t["floor"] for t in tables])
        grams, gram_bits, contexts, context_bits = [], [], [], []
        lower_keys, lower = np.zeros(1, np.uint64), floor[None, :]
        for k in range(1, order + 1):
            names = np.unique(np.concatenate([t[k]["context"] for t in tables]))
            backoff = np.ones((len(names), len(languages)))
            keys, first = np.unique(np.concatenate([t[k]["gram"] for t in tables]), return_index=True)
            context, suffix = (np.concatenate([t[k][side] for t in tables])[first] for side in ("gram_context", "gram_suffix"))
            prob = np.zeros((len(keys), len(languages)))
            for i, t in enumerate(tables):
                backoff[np.searchsorted(names, t[k]["context"]), i] = t[k]["backoff"]
                prob[np.searchsorted(keys, t[k]["gram"]), i] = t[k]["prob"]
            prob += backoff[np.searchsorted(names, context)] * lower[np.searchsorted(lower_keys, suffix)]
            grams.append(keys)
            gram_bits.append(-np.log2(prob).astype(np.float32))
            contexts.append(names)
            context_bits.append(-np.log2(backoff).astype(np.float32))
            lower_keys, lower = keys, prob
        return cls(languages, order, grams, gram_bits, contexts, context_bits, -np.log2(floor))

    @staticmethod
    def _estimate(counts: dict[str, int], order: int) -> dict:
        """Discounted probabilities and back-off weights of every order; orders below the highest count continuations."""
        words = sorted(counts)
        codes, at, lengths = _characters(words, order)
        weight = np.repeat(np.array([counts[w] for w in words], np.float64), lengths)
        hashes = _suffix_hashes(codes, order)
        out: dict = {}
        for k in range(order, 0, -1):
            gram = hashes[k][at]
            if k == order:
                keys, first, inverse = np.unique(gram, return_index=True, return_inverse=True)
                count = np.bincount(inverse, weight)
            else:
                # in how many different characters' company the gram occurs
                _, once = np.unique(hashes[k + 1][at], return_index=True)
                keys, first, inverse = np.unique(gram[once], return_index=True, return_inverse=True)
                count, first = np.bincount(inverse).astype(np.float64), once[first]
            ones, twos = float((count == 1).sum()), float((count == 2).sum())
            discount = ones / (ones + 2 * twos) if ones and twos else 0.5
            context = hashes[k - 1][at[first] - 1]
            names, inverse = np.unique(context, return_inverse=True)
            total, kinds = np.bincount(inverse, count), np.bincount(inverse)
            out[k] = {
                "gram": keys, "gram_context": context, "gram_suffix": hashes[k - 1][at[first]], "prob": (count - discount) / total[inverse],
                "context": names, "backoff": discount * kinds / total,
            }
        out["floor"] = 1.0 / (len(np.unique(codes[at])) + 1000.0)
        return out

    def bits(self, words: list[str]) -> np.ndarray:
        """The bits of each word under each language's model."""
        out = np.zeros((len(words), len(self.languages)))
        # words are taken in runs, so that very many need no more memory at once
        at = 0
        while at < len(words):
            end, chars = at, 0
            while end < len(words) and (end == at or chars + len(words[end]) < CHARS_AT_ONCE):
                chars += len(words[end]) + 1
                end += 1
            codes, places, counts = _characters(words[at:end], self.order)
            out[at:end] = np.add.reduceat(self._char_bits(codes, places), np.cumsum(counts) - counts)
            at = end
        return out

    def _char_bits(self, codes: np.ndarray, places: np.ndarray) -> np.ndarray:
        hashes = _suffix_hashes(codes, self.order)
        out = np.zeros((len(places), len(self.languages)))
        left = np.arange(len(places))
        for k in range(self.order, 0, -1):
            slot, known = self._find(self.grams[k - 1], hashes[k][places[left]])
            hit = left[known]
            out[hit] += self.gram_bits[k - 1][slot[known]]
            left = left[~known]
            if not len(left):
                return out
            slot, known = self._find(self.contexts[k - 1], hashes[k - 1][places[left] - 1])
            out[left[known]] += self.context_bits[k - 1][slot[known]]
        out[left] += self.unseen
        return out

    @staticmethod
    def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return at, keys[at] == wanted


class ModelGroups:
    """The models of all languages, a few in common arrays: memory grows with the languages, not with their square."""

    def __init__(self, groups: list[CharModels]):
        self.groups, self.languages = groups, [lang for g in groups for lang in g.languages]
        self.center, self.spread, self.scale = np.full(len(self.languages), np.inf), np.zeros(len(self.languages)), (1.0, 0.0)

    @classmethod
    def fit(cls, counts: dict[str, dict[str, int]], order: int) -> ModelGroups:
        names = sorted(counts)
        return cls([CharModels.fit({n: counts[n] for n in names[i : i + GROUP]}, order) for i in range(0, len(names), GROUP)])

    def bits(self, words: list[str]) -> np.ndarray:
        return np.concatenate([g.bits(words) for g in self.groups], axis=1)

    def thresholds(self, best: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """The highest cross-entropy that language ``best`` accepts of texts of so many characters."""
        return self.center[best] + self.spread[best] * scatter(chars)


def scatter(chars: np.ndarray) -> np.ndarray:
    """How much further a text's entropy strays from its language's than that of a very long one."""
    return np.sqrt(1 + SHORT_CHARS / np.maximum(chars, 1))


class Identifier:
    """Scores whole texts, many at once; bits of recent words are kept."""

    def __init__(self, models: ModelGroups):
        self.models = models
        self.places: dict[str, int] = {}
        self.room = max(2 * WORDS_AT_ONCE + 1, min(CACHE_WORDS, GROUP * CACHE_WORDS // len(models.languages)))
        self.table = np.zeros((self.room, len(models.languages)))
        self.used = 0

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Of each text the cross-entropy a character under each language, and the number of characters (with word ends)."""
        total, chars = np.zeros((len(texts), len(self.models.languages))), np.zeros(len(texts), np.int64)
        held: list[str] = []
        owners: list[int] = []
        counts: list[int] = []
        for i, text in enumerate(texts):
            words = words_of(text)
            chars[i] = sum(map(len, words)) + len(words)
            for at in range(0, len(words), WORDS_AT_ONCE):
                part = words[at : at + WORDS_AT_ONCE]
                held += part
                owners.append(i)
                counts.append(len(part))
                if len(held) >= WORDS_AT_ONCE:
                    self._add(total, held, owners, counts)
                    held, owners, counts = [], [], []
        if held:
            self._add(total, held, owners, counts)
        return total / np.maximum(chars, 1)[:, None], chars

    def _add(self, total: np.ndarray, words: list[str], owners: list[int], counts: list[int]) -> None:
        """Add the bits of words, of which so many in a row belong to each owner; at most twice WORDS_AT_ONCE come."""
        places = list(map(self.places.get, words))
        if None in places:
            fresh = list({w for w, p in zip(words, places, strict=True) if p is None})
            if self.used + len(fresh) > self.room:
                self.places, self.used = {}, 0
                fresh = list(set(words))
            self.table[self.used : self.used + len(fresh)] = self.models.bits(fresh)
            self.places.update(zip(fresh, range(self.used, self.used + len(fresh)), strict=True))
            self.used += len(fresh)
            places = list(map(self.places.__getitem__, words))
            for w in fresh:
                if len(w) > LONGEST_CACHED:
                    del self.places[w]
        sums = np.add.reduceat(self.table[np.array(places)], np.cumsum(counts) - counts)
        np.add.at(total, owners, sums)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float], list[bool]]:
        """Of each text the language, the confidence from 0 to 1, its cross-entropy, and whether that is accepted."""
        entropy, chars = self.entropies(texts)
        best = entropy.argmin(1)
        lowest = entropy[np.arange(len(texts)), best]
        lead = np.partition(entropy, 1, axis=1)[:, 1] - lowest if entropy.shape[1] > 1 else np.ones(len(texts))
        slope, offset = self.models.scale
        score = 1.0 / (1.0 + np.exp(-np.clip(slope * lead * np.sqrt(chars) + offset, -40, 40)))
        out = (
            [self.models.languages[i] for i in best.tolist()], score.tolist(), lowest.tolist(), (lowest <= self.models.thresholds(best, chars)).tolist(),
        )
        for i in np.flatnonzero(chars == 0).tolist():
            text = texts[i]
            if text and any(unicodedata.category(c)[0] == "L" for c in text):  # letters, but no word
                found = (self.models.languages[0], 0.0, float("inf"), False)
            else:
                found = (UNKNOWN, 0.0, 0.0, False)
            for column, value in zip(out, found, strict=True):
                column[i] = value
        return out


def sample_ids(docs: DataFrame, id_col: str, lang_col: str, learn: Column, limits: FitLimits) -> DataFrame:
    """``id, lang`` of the documents to fit on: of each label the ids with the smallest hashes. No text is read for it."""
    labelled = docs.where(learn & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(lang_col).alias("__lang"))
    hashed = labelled.withColumn("__h", F.xxhash64("__id")).withColumn("__bucket", F.shiftright("__h", 64 - BUCKET_BITS))
    # a label may have a third of all rows: the bucket of hashes that its sample reaches into comes from counts, a row a bucket,
    # and only rows up to it are ranked
    counts = hashed.groupBy("__lang", "__bucket").count()
    before = F.sum("count").over(Window.partitionBy("__lang").orderBy("__bucket")) - F.col("count")
    last = counts.withColumn("__n", before).where(F.col("__n") < limits.docs).groupBy("__lang").agg(F.max("__bucket").alias("__last"))
    # a row a label: no more than the models that the driver makes of them
    near = hashed.join(F.broadcast(last), "__lang").where(F.col("__bucket") <= F.col("__last")).select("__id", "__lang", "__h").distinct()
    rank = F.row_number().over(Window.partitionBy("__lang").orderBy("__h", "__id"))
    return near.withColumn("__k", rank).where(F.col("__k") <= limits.docs).drop("__k")


def fit(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", limits: FitLimits = FitLimits()) -> ModelGroups:
    """Fit models, acceptance thresholds and the confidence scale on the labelled rows where ``learn`` holds.

    Every label is learned. The sample of each is bounded by ``limits``; all its words are counted by Spark, whole. Rows without label or text teach nothing.
    """
    ids = sample_ids(docs, id_col, lang_col, learn, limits)
    # at most limits.docs ids a label
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text")).join(F.broadcast(ids), "__id")
    held = F.pmod(F.col("__h"), F.lit(limits.calibrate_one_in)) == 0

    def make():
        return lambda texts: ([words_of(t) for t in texts],)

    split = append_columns(texts.where(~held).select("__lang", "__text"), ["__text"], [T.StructField("__words", T.ArrayType(T.StringType()))], make).select("__lang", F.explode("__words").alias("word"))
    counts: dict[str, dict[str, int]] = defaultdict(dict)
    for lang, word, n in split.groupBy("__lang", "word").count().toLocalIterator():
        counts[lang][word] = n
    if not counts:
        return ModelGroups.fit({UNKNOWN: {"a": 1}}, limits.order)
    models = ModelGroups.fit(counts, limits.order)
    _calibrate(models, texts.where(held).select("__lang", "__text"), texts.select("__lang", "__text"))
    return models


def _calibrate(models: ModelGroups, held: DataFrame, every: DataFrame) -> None:
    """Set thresholds and scale from held-back texts: entropies and leads only come to the driver, a row a sampled document.

    A label's threshold is its median entropy and a multiple of the median deviation, which less than half of junk
    among the texts can't move far. Labels with few texts take the pooled figures; without any held-back text
    ``every`` sampled one calibrates.
    """
    shared = held.sparkSession.sparkContext.broadcast(models)
    fields = [T.StructField("e", T.ArrayType(T.DoubleType())), T.StructField("chars", T.LongType())]

    def make():
        identifier = Identifier(shared.value)

        def compute(texts):
            entropy, chars = identifier.entropies(texts)
            return entropy.tolist(), chars.tolist()

        return compute

    def entropies(texts: DataFrame) -> list:
        return append_columns(texts, ["__text"], fields, make).where("chars > 0").select("__lang", "e", "chars").collect()

    rows = entropies(held) or entropies(every)
    place = {lang: i for i, lang in enumerate(models.languages)}
    rows = [(place[lang], np.array(e), n) for lang, e, n in rows if lang in place]
    if not rows:
        return
    own = defaultdict(list)
    for i, e, n in rows:
        own[i].append((e[i], n))
    pooled = _center_and_spread([v for values in own.values() for v in values])
    for i in range(len(models.languages)):
        center, spread = _center_and_spread(own[i]) if len(own[i]) >= FEWEST_TEXTS else pooled
        models.center[i], models.spread[i] = center, max(SPREADS * spread, LEAST_ALLOWANCE)
    if len(rows) > 1 and len(models.languages) > 1:
        right = np.array([np.argmin(e) == i for i, e, _ in rows], np.float64)
        lead = np.array([(np.sort(e)[1] - e.min()) * np.sqrt(n) for _, e, n in rows])
        # logistic calibration of the lead; one extra right and wrong row keep it finite
        x, y = np.r_[lead, np.median(lead), 0.0], np.r_[right, 1.0, 0.0]
        w = np.zeros(2)
        features = np.stack([x, np.ones_like(x)], 1)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(features @ w, -30, 30)))
            hessian = features.T @ (features * (p * (1 - p) + 1e-6)[:, None]) + 1e-6 * np.eye(2)
            step = np.linalg.solve(hessian, features.T @ (y - p))
            w += np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-8:
                break
        models.scale = (float(max(w[0], 1e-6)), float(w[1]))


def _center_and_spread(values: list[tuple[float, int]]) -> tuple[float, float]:
    """The median of (entropy, characters) and the robust deviation of texts of great length."""
    e, n = (np.array(v, np.float64) for v in zip(*values, strict=True))
    center = float(np.median(e))
    return center, float(1.4826 * np.median(np.abs(e - center) / scatter(n)))


def predict(df: DataFrame, models: ModelGroups, text_col: str = "text") -> DataFrame:
    """``df`` with lang_pred, score, cross_entropy and accepted (columns of these names are replaced).

    Null texts and texts without a letter give ``und``, score 0, not accepted. Ties go to the label that sorts first.
    """
    return append_columns(df, [text_col], RESULT_FIELDS, _predictor(df, models))


def keep_accepted(df: DataFrame, models: ModelGroups, text_col: str = "text") -> DataFrame:
    """The rows of ``df``, unchanged, whose text some language accepts."""
    return append_columns(df, [text_col], RESULT_FIELDS, _predictor(df, models), keep=lambda values: values[3], drop_new=True)


def _predictor(df: DataFrame, models: ModelGroups):
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(models)

    name = uuid.uuid4().hex

    def make():
        return keep_warm(("languages", name), lambda: Identifier(shared.value)).predict

    return make
