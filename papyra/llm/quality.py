"""Quality classifier: a generalised additive model with pairwise interactions.

Every text becomes a fixed list of features from its bytes and words. Features are cut into
bins at quantiles of the training rows. The model is a sum of lookup tables, one per feature and
one per chosen pair of features. They are learned by cyclic boosting of shallow trees: in every
round each feature in turn fits a tree of at most three leaves to the current residuals of the
log loss, on the histogram of its bins, and adds it, scaled down, to its table. Then pairs are
ranked by how much a tree with one cut on each axis would gain on what is left, the best are
kept, and boosting goes on over these. A score is the intercept plus one bin addition per
table, through the logistic function, for whole batches at once.

Labels are read only of rows whose ``crc32(id as text) mod 5`` is not 0. At most ``SAMPLE`` of
them (those with the smallest hash of their id) train the model on the driver; this is the only
bound, everything else covers all rows. Ids, labels, languages and sources are no features.

Defined results: null and empty texts have features of zero and a score like any other. Rows with a
null label or id do not train; of repeated labels the largest counts, of differing texts of one id the
one with the smallest hash. Ties between bins, cuts and pairs go to the first. Texts of any length are
read whole. Where no usable label is left, or only one kind, every score is the share of good labels (0.5 without any).
Repeated rows are scored each; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyra.llm.common import map_rows, text_bytes

#: Most labelled rows that train the model.
SAMPLE = 20_000
BINS = 32
ROUNDS = 150
PAIR_ROUNDS = 60
PAIRS = 8
RATE = 0.1
#: A leaf needs this much of the log loss's second derivative; leaves shrink by as much.
LEAST, SHRINK = 2.0, 1.0
#: A score of at least this is predicted 1.
THRESHOLD = 0.3

FEATURES = (
    "log_bytes", "log_words", "word_bytes", "upper", "digits", "symbols", "ends", "blanks", "feeds", "high",
    "distinct", "top_word", "repeats", "line_words", "repeated_lines", "marked_words", "lone_signs", "capitals",
    "sentences", "packed",
)

_UPPER = bytes(range(0x41, 0x5B))
_DIGITS = bytes(range(0x30, 0x3A))
_LETTERS = bytes([*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
_ENDS = b".,;:!?"
_BLANKS = b" \t\r\n\x0b\x0c"
_HIGH = bytes(range(0x80, 0x100))
_SYMBOLS = bytes(set(range(256)) - set(_LETTERS + _DIGITS + _ENDS + _BLANKS))


def features(raw: bytes) -> list[float]:
    """The features of one text; shares are between 0 and 1."""
    n = len(raw)
    if not n:
        return [0.0] * len(FEATURES)
    words = raw.split()
    w = len(words)
    share = lambda signs: (n - len(raw.translate(None, signs))) / n
    counts = Counter(words)
    lines = raw.split(b"\n")
    full = [x for x in lines if x]
    some = max(w, 1)
    marked = sum(c for x, c in counts.items() if x[-1:] in _MARKS)
    lone = sum(c for x, c in counts.items() if len(x) == 1 and x in _SYMBOL_WORDS)
    capital = sum(c for x, c in counts.items() if len(x) > 1 and x.isupper())
    return [
        np.log1p(n), np.log1p(w), sum(map(len, words)) / some, share(_UPPER), share(_DIGITS), share(_SYMBOLS),
        share(_ENDS), share(_BLANKS), share(b"\n"), share(_HIGH), len(counts) / some,
        max(counts.values(), default=0) / some, sum(map(bytes.__eq__, words, words[1:])) / some,
        np.log1p(w / max(len(full), 1)), 1 - len(set(full)) / max(len(full), 1), marked / some, lone / some,
        capital / some, (raw.count(b". ") + raw.count(b".\n") + raw.endswith(b".")) / some, len(zlib.compress(raw, 1)) / n,
    ]


_MARKS = frozenset(bytes([c]) for c in _SYMBOLS + b"!?" if c < 0x80)
_SYMBOL_WORDS = frozenset(bytes([c]) for c in _SYMBOLS)


def matrix(texts: list[bytes]) -> np.ndarray:
    return np.array([features(t) for t in texts], dtype=np.float64).reshape(len(texts), len(FEATURES))


@dataclass
class AdditiveModel:
    """Lookup tables over binned features and pairs of them."""

    intercept: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(c, x[:, i], side="right") for i, c in enumerate(self.cuts)]

    def logits(self, bins: list[np.ndarray], n: int) -> np.ndarray:
        out = np.full(n, self.intercept)
        for b, t in zip(bins, self.tables, strict=True):
            out += t[b]
        for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
            out += t[bins[i], bins[j]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logits(self.bins(x), len(x))))


def _leaf(g, h):
    return g / (h + SHRINK)


def _gain(g, h):
    return g * g / (h + SHRINK)


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The step of a tree of at most three leaves over ordered bins; g, h: sums of derivatives by bin."""
    out = np.full(len(g), _leaf(g.sum(), h.sum()))

    def best(lo, hi):
        cg, ch = np.cumsum(g[lo:hi])[:-1], np.cumsum(h[lo:hi])[:-1]
        tg, th = g[lo:hi].sum(), h[lo:hi].sum()
        if not len(cg):
            return 0.0, None
        gain = _gain(cg, ch) + _gain(tg - cg, th - ch) - _gain(tg, th)
        gain[(ch < LEAST) | (th - ch < LEAST)] = 0
        at = int(gain.argmax())
        return float(gain[at]), lo + at + 1

    gain, cut = best(0, len(g))
    if gain <= 1e-9:
        return out
    left, right = best(0, cut), best(cut, len(g))
    cuts = [cut]
    more = max(left, right, key=lambda x: x[0])
    if more[0] > 1e-9:
        cuts = sorted([cut, more[1]])
    for lo, hi in zip([0, *cuts], [*cuts, len(g)], strict=True):
        out[lo:hi] = _leaf(g[lo:hi].sum(), h[lo:hi].sum())
    return out


def _cross(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and step of the best tree with one cut on each axis of a two-way histogram."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    tg, th = cg[-1, -1], ch[-1, -1]
    a, ah = cg[:-1, :-1], ch[:-1, :-1]
    b, bh = cg[:-1, -1:] - a, ch[:-1, -1:] - ah
    c, c_h = cg[-1:, :-1] - a, ch[-1:, :-1] - ah
    d, dh = tg - a - b - c, th - ah - bh - c_h
    gain = _gain(a, ah) + _gain(b, bh) + _gain(c, c_h) + _gain(d, dh) - _gain(tg, th)
    gain[np.minimum(np.minimum(ah, bh), np.minimum(c_h, dh)) < LEAST] = 0
    i, j = np.unravel_index(int(gain.argmax()), gain.shape) if gain.size else (0, 0)
    step = np.zeros_like(g)
    if not gain.size or gain[i, j] <= 1e-9:
        return 0.0, step
    step[: i + 1, : j + 1], step[: i + 1, j + 1 :] = _leaf(a[i, j], ah[i, j]), _leaf(b[i, j], bh[i, j])
    step[i + 1 :, : j + 1], step[i + 1 :, j + 1 :] = _leaf(c[i, j], c_h[i, j]), _leaf(d[i, j], dh[i, j])
    return float(gain[i, j]), step


def fit(
    x: np.ndarray, y: np.ndarray, bins: int = BINS, rounds: int = ROUNDS, pairs: int = PAIRS,
    pair_rounds: int = PAIR_ROUNDS, rate: float = RATE,
) -> AdditiveModel:
    """Learn the tables from features and 0/1 labels."""
    model = AdditiveModel()
    if not len(y):
        return model
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    model.intercept = float(np.log(share / (1 - share)))
    if y.min() == y.max():
        return model
    for i in range(x.shape[1]):
        model.cuts.append(np.unique(np.quantile(x[:, i], np.linspace(0, 1, bins + 1)[1:-1])))
    b = model.bins(x)
    sizes = [len(c) + 1 for c in model.cuts]
    model.tables = [np.zeros(s) for s in sizes]
    f = np.full(len(y), model.intercept)

    def derivatives():
        p = 1 / (1 + np.exp(-f))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for i, n in enumerate(sizes):
            g, h = derivatives()
            step = rate * _tree(np.bincount(b[i], g, n), np.bincount(b[i], h, n))
            model.tables[i] += step
            f += step[b[i]]

    def histogram(i, j):
        g, h = derivatives()
        at, shape = b[i] * sizes[j] + b[j], (sizes[i], sizes[j])
        n = sizes[i] * sizes[j]
        return np.bincount(at, g, n).reshape(shape), np.bincount(at, h, n).reshape(shape)

    ranked = sorted(((_cross(*histogram(i, j))[0], i, j) for i in range(len(sizes)) for j in range(i)), reverse=True)
    model.pairs = [(i, j) for gain, i, j in ranked[:pairs] if gain > 0]
    model.pair_tables = [np.zeros((sizes[i], sizes[j])) for i, j in model.pairs]
    for _ in range(pair_rounds):
        for k, (i, j) in enumerate(model.pairs):
            _, step = _cross(*histogram(i, j))
            model.pair_tables[k] += rate * step
            f += rate * step[b[i], b[j]]
    return model


def held_out(id_column: Column) -> Column:
    """Whether a row is kept from training."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _feature_rows():
    return lambda texts: (matrix(texts).tolist(),)


def train(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "quality",
) -> AdditiveModel:
    """Fit the model to the texts of at most ``sample`` labelled rows that are not held out."""
    usable = labels.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{label_col}`").cast("int").alias("__y"))
    usable = usable.filter(F.col("__y").isin(0, 1) & F.col("__id").isNotNull() & ~held_out(F.col("__id")))
    usable = usable.groupBy("__id").agg(F.max("__y").alias("__y"))
    # A top-n by hash: every task hands on at most ``sample`` rows, and the picked ids are bounded by it too.
    picked = usable.orderBy(F.xxhash64("__id"), "__id").limit(sample)
    texts = docs.select(F.col(f"`{id_col}`").alias("__id"), text_bytes(text_col).alias("__text"))
    # One text an id, before anything is collected: a task hands on at most ``sample`` of them.
    rows = texts.join(F.broadcast(picked), "__id").groupBy("__id", "__y").agg(
        F.min(F.struct(F.xxhash64("__text").alias("h"), "__text")).alias("t")
    )
    out = T.StructType([T.StructField("x", T.ArrayType(T.DoubleType()))])
    got = map_rows(rows, [F.col("t.__text")], out, _feature_rows, keep=["__id", "__y"]).collect()
    got = sorted(got, key=lambda r: r["__id"])  # one order on every run
    return fit(np.array([r["x"] for r in got]).reshape(len(got), len(FEATURES)), np.array([r["__y"] for r in got], float))


def _scorer(model: AdditiveModel):
    return lambda texts: (model.score(matrix(texts)).tolist(),)


_SCORE = T.StructType([T.StructField("score", T.DoubleType())])


def score_quality(
    docs: DataFrame, model: AdditiveModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """``id, held_out, score, predicted`` of every text."""
    rows = docs.select(F.col(f"`{id_col}`").alias("__id"), text_bytes(text_col).alias("__text"))
    scored = map_rows(rows, [F.col("__text")], _SCORE, _scorer, (model,), keep=["__id"])
    return scored.select(
        F.col("__id").alias(id_col), held_out(F.col("__id")).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, model: AdditiveModel, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose text is predicted 1, with all their columns."""
    named = {c: f"__c{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in named.items()])
    scored = map_rows(rows, [text_bytes(named[text_col])], _SCORE, _scorer, (model,), keep=list(named.values()))
    return scored.filter(F.col("score") >= threshold).select(*[F.col(n).alias(c) for c, n in named.items()])
