"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its features come from the line and from its neighbours; the chain adds how labels follow one
another. Labels exist for whole documents only, so lines are hidden and a document's label is evidence on each of them, which a
stray line may go against. Weights are those of the largest conditional likelihood, with gradients from forward-backward. The same
gives each line's probability of being good; weighted by length these add up to the document's score.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from findlake.llm.arrow import append_columns
from findlake.llm.storage import small_batches

WORD = re.compile(r"[^\W\d_]+")
SYMBOL_RUN = re.compile(r"[^\w\s]{2,}")
RESULT_FIELDS = [T.StructField("score", T.DoubleType()), T.StructField("n_lines", T.LongType()), T.StructField("good_lines", T.LongType())]
EMPTY_SCORE = 0.0
#: The share of lines that are expected to go against their document's label.
STRAY = 0.1


def line_features(line: str) -> list[float]:
    """Shares and shapes of one line; all between 0 and about 1."""
    n = len(line)
    if not n:
        return [0.0] * N_OWN
    words = line.split()
    count = len(words) or 1
    letters = sum(map(len, WORD.findall(line)))
    upper = sum(w.isupper() and len(w) > 1 for w in words)
    digits = sum(map(str.isdigit, line)) if any(c in line for c in "0123456789") else 0
    spaces = line.count(" ")
    symbols = max(0, n - letters - digits - spaces)
    runs = len(SYMBOL_RUN.findall(line))
    lower = [w.lower().strip(".,;:!?") for w in words]
    bars = line.count("|")
    end = line.rstrip()[-1:]
    return [
        letters / n, digits / n, min(1.0, symbols / n * 3), upper / count, runs / count, min(1.0, bars / count * 2),
        len(set(lower)) / count, min(1.0, sum(map(len, words)) / count / 15), min(1.0, len(words) / 30), min(1.0, n / 200),
        float(end in ".!?\"'"), float(end in ",;:"), min(1.0, sum(w[:1].isupper() for w in words) / count), float("http" in line or "www." in line),
        min(1.0, line.count(".") / count), min(1.0, (line.count("!") + line.count("?")) / count),
        sum(a == b for a, b in zip(lower, lower[1:], strict=False)) / count,
    ]


N_OWN = 17
#: own, previous, next, mean of the window, first, last, repeated in the document, constant
N_FEATURES = 4 * N_OWN + 4


def document_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """A row of features a line that isn't blank, and the lines' lengths."""
    lines = [x for x in text.splitlines() if x.strip()] if text else []
    if not lines:
        return np.zeros((0, N_FEATURES), np.float32), np.zeros(0)
    memo: dict[str, list[float]] = {}
    own = np.array([memo[x] if x in memo else memo.setdefault(x, line_features(x)) for x in lines], np.float32)
    before, after = np.vstack([np.zeros((1, N_OWN), np.float32), own[:-1]]), np.vstack([own[1:], np.zeros((1, N_OWN), np.float32)])
    sums = np.vstack([np.zeros((1, N_OWN)), np.cumsum(own, 0, dtype=np.float64)])
    at = np.arange(len(lines))
    low, high = np.maximum(0, at - 2), np.minimum(len(lines), at + 3)
    around = ((sums[high] - sums[low]) / (high - low)[:, None]).astype(np.float32)
    seen: dict[str, int] = {}
    for x in lines:
        seen[x] = seen.get(x, 0) + 1
    more = np.array([[float(i == 0), float(i == len(lines) - 1), float(seen[x] > 1), 1.0] for i, x in enumerate(lines)], np.float32)
    return np.hstack([own, before, after, around, more]), np.array([len(x) for x in lines], np.float64)


@dataclass
class LineField:
    """Weights of the features for "good" against "bad", the 2 x 2 transition scores, and the calibration of scores."""

    weights: np.ndarray
    transitions: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def marginals(self, features: np.ndarray) -> np.ndarray:
        """P(good) of every line of a document, by forward-backward."""
        return marginals(features @ self.weights, self.transitions)

    def raw(self, text: str | None) -> tuple[float | None, int, int]:
        """The length-weighted log-odds of a document, its lines, and the good ones among them."""
        features, lengths = document_features(text)
        if not len(lengths):
            return None, 0, 0
        good = self.marginals(features)
        share = float(np.clip((good * lengths).sum() / lengths.sum(), 1e-6, 1 - 1e-6))
        return float(np.log(share / (1 - share))), len(good), int((good >= 0.5).sum())

    def score(self, text: str | None) -> tuple[float, int, int]:
        value, lines, good = self.raw(text)
        if value is None:
            return EMPTY_SCORE, 0, 0
        return float(1 / (1 + np.exp(-np.clip(self.slope * value + self.offset, -40, 40)))), lines, good


def marginals(odds: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """P(good) in a chain with scores (0, odds) a line; states are bad, good."""
    n = len(odds)
    ahead, behind = np.zeros((n, 2)), np.zeros((n, 2))
    t00, t01, t10, t11 = map(float, np.exp(transitions).ravel())
    e = np.exp(np.clip(odds, -30, 30)).tolist()
    a0, a1 = 1.0, e[0]
    s = a0 + a1
    a0, a1 = a0 / s, a1 / s
    ahead[0] = a0, a1
    for i in range(1, n):
        a0, a1 = a0 * t00 + a1 * t10, (a0 * t01 + a1 * t11) * e[i]
        s = a0 + a1
        a0, a1 = a0 / s, a1 / s
        ahead[i] = a0, a1
    b0 = b1 = 1.0
    behind[n - 1] = b0, b1
    for i in range(n - 2, -1, -1):
        x = e[i + 1] * b1
        b0, b1 = t00 * b0 + t01 * x, t10 * b0 + t11 * x
        s = b0 + b1
        b0, b1 = b0 / s, b1 / s
        behind[i] = b0, b1
    both = ahead * behind
    return both[:, 1] / both.sum(1)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float, rounds: int = 25) -> np.ndarray:
    """Weighted ridge logistic regression by Newton steps; targets may lie between 0 and 1."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (weight * np.maximum(p * (1 - p), 1e-5))[:, None] * x
        step = np.linalg.solve(x.T @ h + ridge * np.eye(x.shape[1]), x.T @ (weight * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


class Chains:
    """Line chains of many documents side by side, longest first, for forward-backward over all of them at once."""

    def __init__(self, lengths: list[int]):
        n = np.array(lengths)
        order = np.argsort(-n, kind="stable")
        starts = np.cumsum(n) - n
        #: for each place in a document, the lines at that place, of the documents that are so long
        self.lines = [starts[order[: int((n > t).sum())]] + t for t in range(int(n.max()))]

    def expect(self, odds: np.ndarray, transitions: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """The weighted sum of log partition functions, P(good) of every line, and weighted expected counts of label pairs.

        ``odds`` and ``weight`` are given a line; the weight of a line is that of its document.
        """
        t = np.exp(transitions)
        e = np.exp(np.clip(odds, -30, 30))
        ahead, total = [], 0.0
        for i, lines in enumerate(self.lines):
            now = np.stack([np.ones(len(lines)), e[lines]], 1)
            if i:
                now *= ahead[-1][: len(lines)] @ t
            scale = now.sum(1, keepdims=True)
            total += float((weight[lines] * np.log(scale[:, 0])).sum())
            ahead.append(now / scale)
        good, pairs, behind = np.zeros(len(odds)), np.zeros((2, 2)), np.zeros((0, 2))
        for i in range(len(self.lines) - 1, -1, -1):
            lines = self.lines[i]
            back = np.ones((len(lines), 2))
            if len(behind):
                after = self.lines[i + 1]
                step = behind * np.stack([np.ones(len(after)), e[after]], 1)
                joint = ahead[i][: len(after), :, None] * t[None] * step[:, None, :]
                pairs += (joint * (weight[after] / joint.sum((1, 2)))[:, None, None]).sum(0)
                back[: len(after)] = step @ t.T
            both = ahead[i] * back
            good[lines] = both[:, 1] / both.sum(1)
            behind = back / back.sum(1, keepdims=True)
        return total, good, pairs


def log_likelihood(parameters: np.ndarray, x: np.ndarray, chains: Chains, evidence: np.ndarray, weight: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """The penalised conditional log-likelihood of the documents' labels, and its gradient.

    Lines are hidden; a document's label is ``evidence`` (in log-odds) on each of its lines. The likelihood is the ratio of the chain's
    partition functions with and without the evidence, its gradient the difference of expected features.
    """
    w, transitions = parameters[:-4], parameters[-4:].reshape(2, 2)
    odds = x @ w
    held, good, pairs = chains.expect(odds + evidence, transitions, weight)
    free, any_good, any_pairs = chains.expect(odds, transitions, weight)
    # what the evidence itself weighs
    value = held - free - float((weight * np.log1p(np.exp(evidence))).sum()) - ridge / 2 * float(parameters @ parameters)
    gradient = np.r_[x.T @ (weight * (good - any_good)), (pairs - any_pairs).ravel()] - ridge * parameters
    return value, gradient


def _maximise(function, at: np.ndarray, rounds: int, memory: int = 8) -> np.ndarray:
    """Limited-memory quasi-Newton ascent with step halving."""
    value, gradient = function(at)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        direction, kept = gradient.copy(), []
        for s, y in reversed(steps):
            a = (s @ direction) / (s @ y)
            kept.append(a)
            direction -= a * y
        direction *= (steps[-1][0] @ steps[-1][1]) / (steps[-1][1] @ steps[-1][1]) if steps else 1 / max(1.0, float(np.abs(gradient).max()))
        for (s, y), a in zip(steps, reversed(kept), strict=True):
            direction += (a - (y @ direction) / (s @ y)) * s
        slope, length = float(gradient @ direction), 1.0
        while True:
            new = at + length * direction
            new_value, new_gradient = function(new)
            if new_value >= value + 1e-4 * length * slope or length < 1e-6:
                break
            length /= 2
        if new_value <= value + 1e-7 * abs(value):
            break
        s, y = new - at, gradient - new_gradient
        if s @ y > 1e-10:
            steps = [*steps[1 - memory :], (s, y)]
        at, value, gradient = new, new_value, new_gradient
    return at


def fit_field(documents: list[tuple[np.ndarray, np.ndarray, int]], rounds: int = 40, ridge: float = 2.0) -> LineField:
    """Fit on (features, lengths, label) of documents by the conditional likelihood of the labels under the chain.

    Every document counts the same, and so do both labels however rare one is. Without both labels the field is constant: all good,
    or all bad if only bad documents are known.
    """
    documents = [d for d in documents if len(d[1])]
    labels = {d[2] for d in documents}
    if len(labels) < 2:
        constant = np.zeros(N_FEATURES)
        constant[-1] = 4.0 if labels != {0} else -4.0
        return LineField(constant, np.zeros((2, 2)))
    lines = [len(d[1]) for d in documents]
    x = np.vstack([d[0] for d in documents]).astype(np.float64)
    label = np.array([d[2] for d in documents], np.float64)
    share = np.where(label == 1, 0.5 / (label == 1).sum(), 0.5 / (label == 0).sum()) * len(documents)
    chains = Chains(lines)
    evidence = np.repeat(np.where(label == 1, 1.0, -1.0), lines) * math.log((1 - STRAY) / STRAY)
    weight = np.repeat(share / np.array(lines), lines)
    found = _maximise(lambda p: log_likelihood(p, x, chains, evidence, weight, ridge), np.zeros(N_FEATURES + 4), rounds)
    field = LineField(found[:-4], found[-4:].reshape(2, 2))
    good = chains.expect(x @ field.weights, field.transitions, weight)[1]
    length = np.concatenate([d[1] / d[1].sum() for d in documents])
    p = np.clip(np.add.reduceat(good * length, np.cumsum(lines) - lines), 1e-6, 1 - 1e-6)
    slope, offset = _logistic(np.stack([np.log(p / (1 - p)), np.ones(len(p))], 1), label, np.ones(len(p)), 1.0)
    field.slope, field.offset = float(max(slope, 1e-3)), float(offset)
    return field


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_docs: int = 4000, max_lines: int = 400) -> LineField:
    """Fit on at most ``max_docs`` labelled documents where ``learn`` (an expression on ``id_col``) holds.

    They are those with the smallest hash of their id, half of the places for each label where it has as many; of documents of over
    ``max_lines`` lines a run of so many is learned from, at a place that a checksum of the text chooses. An id with both labels counts
    as good. Features, not texts, come to the driver: max_docs * max_lines rows at most.
    """
    known = labels.where(F.col(label_col).isNotNull() & learn).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("__label"))
    parts = [known.where(F.col("__label") == v).orderBy(F.xxhash64("__id"), "__id").limit(max_docs // 2) for v in (0, 1)]
    chosen = parts[0].unionByName(parts[1])
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text")).join(F.broadcast(chosen), "__id").select("__label", "__text")
    fields = [T.StructField("__x", T.BinaryType()), T.StructField("__n", T.BinaryType())]

    def make():
        def compute(texts):
            both = [document_features(t) for t in texts]
            for i, (x, n) in enumerate(both):
                if len(n) > max_lines:
                    at = zlib.crc32(texts[i].encode()) % (len(n) - max_lines + 1)
                    both[i] = x[at : at + max_lines], n[at : at + max_lines]
            return [x.astype(np.float32).tobytes() for x, _ in both], [n.tobytes() for _, n in both]

        return compute

    rows = append_columns(texts, ["__text"], fields, make).select("__label", "__x", "__n").collect()
    documents = sorted(((bytes(n), bytes(x), int(label)) for label, x, n in rows), key=lambda r: (r[2], r[0], r[1]))
    return fit_field([(np.frombuffer(x, np.float32).reshape(-1, N_FEATURES), np.frombuffer(n), label) for n, x, label in documents])


def _scorer(df: DataFrame, field: LineField):
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(field)

    def make():
        score = shared.value.score
        return lambda texts: list(zip(*map(score, texts), strict=True))

    return make


def score(df: DataFrame, field: LineField, text_col: str = "text") -> DataFrame:
    """``df`` with score (0 to 1), n_lines and good_lines; null texts and texts of blank lines score 0."""
    return append_columns(df, [text_col], RESULT_FIELDS, _scorer(df, field))


def keep_good(df: DataFrame, field: LineField, threshold: float, text_col: str = "text") -> DataFrame:
    """The rows of ``df``, unchanged, that score ``threshold`` or more."""
    return append_columns(df, [text_col], RESULT_FIELDS, _scorer(df, field), keep=lambda values: [s >= threshold for s in values[0]], drop_new=True)
