"""Quality scores by histogram gradient-boosted trees over statistics of a text.

Trees are grown level by level on binned statistics of a bounded sample of labelled rows, then flattened: every tree is a
full binary tree in arrays (feature, threshold, leaf value), which NumPy descends for a whole batch at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import append, documents, only
from .textnum import AS_IS, NOT_SPACE, blocks, grams, whole

FEATURES = ["log_words", "log_bytes", "word_bytes", "word_spread", "upper", "digit", "not_ascii", "stop", "comma", "exclaim", "bar", "symbol", "line", "same_as_before", "distinct_words", "distinct_pairs", "blank_lines"]

#: Labelled rows that training reads at most, those with the smallest hashes of their ids.
TRAIN_ROWS = 20_000
TREES, DEPTH, RATE, BINS, LEAF_ROWS, RIDGE = 80, 3, 0.15, 64, 10, 1.0


def _of_bytes(*chars: int) -> np.ndarray:
    out = np.zeros(256, dtype=np.float32)
    out[list(chars)] = 1
    return out


_CLASSES = {
    "upper": _of_bytes(*range(0x41, 0x5B)), "digit": _of_bytes(*range(0x30, 0x3A)), "not_ascii": _of_bytes(*range(0x80, 0x100)), "stop": _of_bytes(*b".?"),
    "comma": _of_bytes(*b",;:"), "exclaim": _of_bytes(*b"!"), "bar": _of_bytes(*b"|"), "symbol": _of_bytes(*b"#*$%&<>"), "line": _of_bytes(*b"\n"),
}


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[at[1:]] - total[at[:-1]]


def _distinct(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((values, owner))
    v, o = values[order], owner[order]
    new = np.ones(len(v), dtype=bool)
    new[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
    return np.bincount(o[new], minlength=n).astype(float)


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text; all finite, null as empty."""
    out = []
    for b in blocks(texts, NOT_SPACE, AS_IS):
        n, words, owner = len(b.first) - 1, b.n_words.astype(float), b.doc_of_word()
        size = np.diff(b.bounds).astype(float)
        per_word, per_byte = np.maximum(words, 1), np.maximum(size, 1)
        lengths = (b.ends - b.starts).astype(float)
        mean = _sums(lengths, b.first) / per_word
        count = {k: _sums(v[b.data], b.bounds) for k, v in _CLASSES.items()}
        inside = whole(b.first, 2)
        again = np.zeros(len(b.hashes))
        again[1:] = inside & (b.hashes[1:] == b.hashes[:-1])
        pairs = grams(b.hashes, 2)
        blank = np.zeros(len(b.data))
        blank[1:] = (b.data[1:] == 10) & (b.data[:-1] == 10)
        of = {
            "log_words": np.log1p(words), "log_bytes": np.log1p(size), "word_bytes": mean, "word_spread": np.sqrt(np.maximum(_sums(lengths**2, b.first) / per_word - mean**2, 0)),
            "same_as_before": _sums(again, b.first) / per_word, "distinct_words": _distinct(b.hashes, owner, n) / per_word,
            "distinct_pairs": _distinct(pairs[inside], owner[: len(pairs)][inside], n) / np.maximum(words - 1, 1), "blank_lines": _sums(blank, b.bounds) / per_word,
        }
        of |= {k: count[k] / (per_byte if k in ("upper", "digit", "not_ascii") else per_word) for k in count}
        out.append(np.stack([of[k] for k in FEATURES], axis=1))
    return np.concatenate(out) if out else np.zeros((0, len(FEATURES)))


@dataclass
class Forest:
    """Trees of one depth: node i of a tree has children 2i + 1 (value up to the threshold) and 2i + 2."""

    prior: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def scores(self, rows: np.ndarray) -> np.ndarray:
        total, inner = np.full(len(rows), self.prior), self.feature.shape[1]
        at = np.arange(len(rows))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(rows), dtype=np.int64)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (rows[at, feature[node]] > threshold[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def train(rows: np.ndarray, labels: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Forest:
    """Logistic loss, second-order gains; bins are quantiles of the sample. Without both labels the forest is its prior."""
    share = (labels.sum() + 1) / (len(labels) + 2)
    prior, inner = float(np.log(share / (1 - share))), 2**depth - 1
    flat = Forest(prior, np.zeros((0, inner), dtype=np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    if not len(labels) or labels.min() == labels.max():
        return flat
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in rows.T]
    binned = np.stack([np.searchsorted(c, x, side="left") for c, x in zip(cuts, rows.T, strict=True)], axis=1)
    n_features = rows.shape[1]
    total = np.full(len(rows), prior)
    features, thresholds, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = labels - p, np.maximum(p * (1 - p), 1e-9)
        feature, threshold = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        node = np.zeros(len(rows), dtype=np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            own = (node - first)[:, None] * (n_features * BINS) + np.arange(n_features) * BINS + binned
            sums = [np.bincount(own.ravel(), weights=np.repeat(x, n_features), minlength=width * n_features * BINS).reshape(width, n_features, BINS) for x in (g, h, np.ones(len(g)))]
            (gl, hl, nl), (gt, ht, nt) = ([s.cumsum(axis=2) for s in sums], [s.sum(axis=2, keepdims=True) for s in sums])
            gain = gl**2 / (hl + RIDGE) + (gt - gl) ** 2 / (ht - hl + RIDGE) - gt**2 / (ht + RIDGE)
            gain[(nl < LEAF_ROWS) | (nt - nl < LEAF_ROWS)] = 0
            for i in range(width):
                f, b = np.unravel_index(int(gain[i].argmax()), gain[i].shape)
                if gain[i, f, b] > 1e-6 and b < len(cuts[f]):
                    feature[first + i], threshold[first + i] = f, cuts[f][b]
            node = 2 * node + 1 + (rows[np.arange(len(rows)), feature[node]] > threshold[node])
        leaf = rate * np.bincount(node - inner, weights=g, minlength=inner + 1) / (np.bincount(node - inner, weights=h, minlength=inner + 1) + RIDGE)
        total += leaf[node - inner]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(leaf)
    return Forest(prior, np.stack(features), np.stack(thresholds), np.stack(leaves))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def with_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with their ``stats``, an array in the order of FEATURES, all finite; of a null text those of an empty one. No rows give no rows."""
    return append(docs, lambda texts: [pa.array(list(statistics(texts)), pa.list_(pa.float64()))], "stats array<double>")


def sample(labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Some ``train_rows`` labels (doc_id, quality), those with the smallest hashes of their ids; held-out, null and other labels than 0 and 1 are left out. A label that stands twice counts twice."""
    known = only(labels, doc_id="long", quality="int").where("quality IN (0, 1) AND doc_id IS NOT NULL").where(~held_out())
    share = min(1.0, 1.1 * train_rows / max(1, known.count()))
    # Ids whose hash lies under the sample's share come first in the order of hashes anyway: no task sends more than its part.
    return known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)


def fit(stats: DataFrame, known: DataFrame, train_rows: int = TRAIN_ROWS) -> Forest:
    """From (doc_id, stats) and a ``sample`` of labels, at most ``train_rows`` of their pairs."""
    rows = stats.select("doc_id", "stats").join(known, "doc_id").orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)), "doc_id", "quality", "stats").limit(train_rows).select("stats", "quality").toPandas()
    return train(np.array(rows["stats"].tolist(), dtype=float).reshape(-1, len(FEATURES)), rows["quality"].to_numpy(dtype=float))


def classify(docs: DataFrame, forest: Forest, cutoff: float = 0.7) -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: good likelier) and ``predicted`` (1 from ``cutoff`` on).

    The score depends on the text alone. Null and empty texts are scored like any other. Rows are scored alone, so repeats
    and ties do no harm; no rows give no rows. Columns of ``docs`` with the new names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def make(texts: pa.Array) -> list[pa.Array]:
        s = shared.value.scores(statistics(texts))
        return [pa.array(s), pa.array((s >= cutoff).astype(np.int32))]

    return append(docs, make, "score double, predicted int")


def train_on(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Forest:
    """A forest from the documents that have labels in the sample; other texts are not looked at.

    The ids of the sample, some ``train_rows`` whatever the size of the tables, go to every task. Repeated rows of a document
    count each; a null or empty text is a text of no words; without labels the forest scores 0.5.
    """
    known = sample(labels, train_rows)
    of_sample = only(docs, doc_id="long", text="string").join(F.broadcast(known.select("doc_id").distinct()), "doc_id", "left_semi")
    return fit(with_statistics(of_sample), known, train_rows)


def op8_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents by a forest trained on the labels that aren't held out; null and empty texts are scored like any other."""
    docs = only(documents(spark, sf_dir), doc_id="long", text="string")
    scored = classify(docs, train_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")
