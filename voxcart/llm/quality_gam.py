"""Quality classifier: a generalised additive model with pairwise interactions.

Each text becomes a few numbers (``FEATURES``).  The model is a sum of lookup tables:
one per feature over its bins, and one per chosen pair of features over coarser bins.
Tables are learned by cyclic boosting: again and again, feature after feature, a tree
with at most three leaves is fitted to the gradients, and its leaf values are added to
that feature's table with a small step.  Pairs are chosen by how much a split of both
features would still gain, and boosted in the same way.  A score is the logistic
function of the added table entries.

The tables are fitted on the driver on at most ``TRAIN_ROWS`` labelled rows, those of
the smallest hash of doc_id, whatever the size of the corpus.  Features of those rows
and the scores of all rows are computed by Spark over whole texts.

Defined results: a NULL text counts as empty, and an empty text gets a score like any
other; without labelled rows all scores are 0.5; a doc_id with several labels counts
with each; repeated rows get equal scores; an empty table gives no rows; further columns
are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxcart.llm.common import written

TRAIN_ROWS = 20_000
BINS = 32
COARSE_BINS = 8
ROUNDS = 150
PAIR_ROUNDS = 60
PAIRS = 6
STEP = 0.08
# Added to second derivatives, and the least sum of them in a leaf.
DAMPING = 1.0
LEAST_WEIGHT = 2.0
PASS_SCORE = 0.3

FEATURES = (
    "log_words", "word_length", "long_words", "distinct_words", "top_word", "same_as_before",
    "repeated_runs", "upper", "digits", "symbols", "exclamations", "stops", "pipes", "foreign",
    "entropy", "words_per_line", "repeated_lines", "ended_lines", "upper_words", "marked_words",
)

_TABLE = np.arange(256)
_IN = {
    "upper": (_TABLE >= 65) & (_TABLE <= 90),
    "digits": (_TABLE >= 48) & (_TABLE <= 57),
    "symbols": np.isin(_TABLE, list(b"#*$%&|<>@^~_=+")),
    "exclamations": np.isin(_TABLE, list(b"!?")),
    "stops": np.isin(_TABLE, list(b".,;:")),
    "pipes": _TABLE == ord("|"),
    "foreign": _TABLE >= 192,  # first bytes of characters outside ASCII
}
_MARKS = b"#*$%&|<>!"


def features(text: str) -> list[float]:
    """The numbers of one whole text, in the order of ``FEATURES``."""
    data = text.encode("utf-8")
    words = data.split()
    n = len(words) or 1
    counts = Counter(words)
    histogram = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    visible = histogram.copy()
    visible[[9, 10, 11, 12, 13, 32]] = 0
    chars = max(1, int(visible.sum()))
    shares = visible[visible > 0] / chars
    lines = [line for line in data.split(b"\n") if line and not line.isspace()]
    n_lines = len(lines) or 1
    # Only equality within the text counts, so the process's own hash will do.
    ids = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)) if words else np.empty(0)
    if len(words) > 5:
        runs = ids[:-4] * 31**4 + ids[1:-3] * 31**3 + ids[2:-2] * 31**2 + ids[3:-1] * 31 + ids[4:]
        repeated = 1.0 - len(np.unique(runs)) / len(runs)
    else:
        repeated = 0.0
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    return [
        float(np.log1p(len(words))),
        float(lengths.sum() / n),
        float((lengths > 12).sum() / n),
        len(counts) / n,
        max(counts.values(), default=0) / n,
        float((ids[1:] == ids[:-1]).sum() / n),
        repeated,
        *(float(visible[chosen].sum() / chars) for chosen in _IN.values()),
        float(-(shares * np.log2(shares)).sum()),
        len(words) / n_lines,
        1.0 - len(set(lines)) / n_lines if lines else 0.0,
        sum(line.rstrip()[-1:] in (b".", b"!", b"?") for line in lines) / n_lines,
        sum(c for w, c in counts.items() if w.isupper() and len(w) > 1) / n,
        sum(c for w, c in counts.items() if w[-1] in _MARKS) / n,
    ]


def with_features(docs: DataFrame) -> DataFrame:
    """``doc_id, features`` of every row."""
    (id_type,) = [f.dataType for f in docs.schema if f.name == "doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "features"]
            )

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {id_type.simpleString()}, features array<double>"
    )


@dataclass
class Model:
    """Lookup tables; all additions of a score are by vector."""

    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    coarse: list[np.ndarray]
    pair_tables: list[np.ndarray]

    def margins(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, x[:, j], side="right")]
        for (j, k), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[
                np.searchsorted(self.coarse[j], x[:, j], side="right"),
                np.searchsorted(self.coarse[k], x[:, k], side="right"),
            ]
        return total

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margins(x), -30, 30)))


def bin_edges(values: np.ndarray, bins: int) -> np.ndarray:
    """Inner edges of bins with about equally many rows, between distinct values."""
    cuts = np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1])
    distinct = np.unique(values)
    places = np.unique(np.searchsorted(distinct, cuts, side="left"))
    places = places[places + 1 < len(distinct)]
    return (distinct[places] + distinct[places + 1]) / 2


def _leaf(gradient: np.ndarray, weight: np.ndarray) -> np.ndarray:
    return gradient / (weight + DAMPING)


def _gain(gradient: np.ndarray, weight: np.ndarray) -> np.ndarray:
    return np.where(weight >= LEAST_WEIGHT, gradient**2 / (weight + DAMPING), -np.inf)


def _best_cut(gradient: np.ndarray, weight: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best split of a run of bins; place 0 for none."""
    if len(gradient) < 2:
        return 0.0, 0
    g, w = np.cumsum(gradient), np.cumsum(weight)
    gains = _gain(g[:-1], w[:-1]) + _gain(g[-1] - g[:-1], w[-1] - w[:-1])
    gains -= g[-1] ** 2 / (w[-1] + DAMPING)
    best = int(gains.argmax())
    return (float(gains[best]), best + 1) if gains[best] > 0 else (0.0, 0)


def shallow_tree(gradient: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Values per bin of a tree with at most three leaves."""
    cuts = [0, len(gradient)]
    _, first = _best_cut(gradient, weight)
    if first:
        cuts.insert(1, first)
        options = [
            (*_best_cut(gradient[low:high], weight[low:high]), low)
            for low, high in zip(cuts, cuts[1:])
        ]
        gain, place, low = max(options)
        if gain > 0 and place:
            cuts = sorted({*cuts, low + place})
    out = np.empty(len(gradient))
    for low, high in zip(cuts, cuts[1:]):
        out[low:high] = _leaf(gradient[low:high].sum(), weight[low:high].sum())
    return out


def shallow_tree_2d(gradient: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values per cell of the best cross of two cuts, one on each axis."""
    g, w = (m.cumsum(0).cumsum(1) for m in (gradient, weight))
    best_gain, out = 0.0, np.zeros_like(gradient)
    whole = g[-1, -1] ** 2 / (w[-1, -1] + DAMPING)

    def corners(m: np.ndarray) -> tuple[np.ndarray, ...]:
        low = m[:-1, :-1]
        right, below = m[:-1, -1:] - low, m[-1:, :-1] - low
        return low, right, below, m[-1, -1] - low - right - below

    if min(gradient.shape) < 2:
        return best_gain, out
    parts_g, parts_w = corners(g), corners(w)
    gains = sum(a**2 / (b + DAMPING) for a, b in zip(parts_g, parts_w)) - whole
    i, k = np.unravel_index(int(gains.argmax()), gains.shape)
    if gains[i, k] > 0:
        best_gain = float(gains[i, k])
        leaves = [_leaf(a[i, k], b[i, k]) for a, b in zip(parts_g, parts_w)]
        out[: i + 1, : k + 1], out[: i + 1, k + 1 :] = leaves[0], leaves[1]
        out[i + 1 :, : k + 1], out[i + 1 :, k + 1 :] = leaves[2], leaves[3]
    return best_gain, out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Tables from features and 0/1 labels."""
    count = x.shape[1] if x.ndim == 2 else len(FEATURES)
    if not len(y):
        none = [np.empty(0)] * count
        return Model(0.0, none, [np.zeros(1)] * count, [], none, [])
    share = (y.sum() + 1.0) / (len(y) + 2.0)
    model = Model(
        float(np.log(share / (1 - share))),
        [bin_edges(x[:, j], BINS) for j in range(count)],
        [],
        [],
        [bin_edges(x[:, j], COARSE_BINS) for j in range(count)],
        [],
    )
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    places = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.edges)]
    margin = np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1.0 / (1.0 + np.exp(-margin))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j, place in enumerate(places):
            gradient, weight = slopes()
            size = len(model.tables[j])
            step = STEP * shallow_tree(
                np.bincount(place, gradient, size), np.bincount(place, weight, size)
            )
            model.tables[j] += step
            margin += step[place]
    coarse = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.coarse)]

    def grid(j: int, k: int, values: np.ndarray) -> np.ndarray:
        shape = len(model.coarse[j]) + 1, len(model.coarse[k]) + 1
        cells = coarse[j] * shape[1] + coarse[k]
        return np.bincount(cells, values, shape[0] * shape[1]).reshape(shape)

    gradient, weight = slopes()
    ranked = sorted(
        (
            (-shallow_tree_2d(grid(j, k, gradient), grid(j, k, weight))[0], j, k)
            for j in range(count)
            for k in range(j + 1, count)
        )
    )
    model.pairs = [(j, k) for gain, j, k in ranked[:PAIRS] if gain < 0]
    model.pair_tables = [
        np.zeros((len(model.coarse[j]) + 1, len(model.coarse[k]) + 1)) for j, k in model.pairs
    ]
    for _ in range(PAIR_ROUNDS):
        for at, (j, k) in enumerate(model.pairs):
            gradient, weight = slopes()
            step = STEP * shallow_tree_2d(grid(j, k, gradient), grid(j, k, weight))[1]
            model.pair_tables[at] += step
            margin += step[coarse[j], coarse[k]]
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most ``rows`` labelled rows that are not held out."""
    sample = (
        labels.where("doc_id IS NOT NULL AND quality IN (0, 1)")
        .where(~held_out(F.col("doc_id")))
        .select("doc_id", F.col("quality").cast("double").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "label")
        .limit(rows)
    )
    # Written, as ordering by ranges would make the features twice.
    sampled = written(
        with_features(docs.join(F.broadcast(sample.select("doc_id").distinct()), "doc_id", "left_semi"))
        .join(F.broadcast(sample), "doc_id"),
        "quality-sample",
    )
    table = sampled.orderBy("doc_id", "label").select("features", "label").toArrow()
    x = np.array(table.column(0).to_pylist(), dtype=float).reshape(-1, len(FEATURES))
    return fit(x, np.array(table.column(1).to_pylist(), dtype=float))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` of every text."""
    (id_type,) = [f.dataType for f in docs.schema if f.name == "doc_id"]
    # Plain values, which need no package on the executors.
    shared = docs.sparkSession.sparkContext.broadcast(dict(vars(model)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(**shared.value)
        for batch in batches:
            if batch.num_rows:
                x = np.array([features(t.as_py() or "") for t in batch.column(1)], dtype=float)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(own.scores(x), pa.float64())],
                    ["doc_id", "score"],
                )

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {id_type.simpleString()}, score double"
    )


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted``."""
    return score(docs, train(docs, labels)).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= PASS_SCORE).cast("int").alias("predicted"),
    )
