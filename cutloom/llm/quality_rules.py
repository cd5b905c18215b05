"""Quality rules: counts over whole texts, and an isolation forest on them.

The forest is grown on the rule statistics of a bounded sample of labelled rows that are marked good and pass the base
rules; its random splits give anomalous documents short paths.  The score at which a document is rejected is calibrated on
all sampled labelled rows: of the cuts that reject at most ``max_loss`` of the good rows, the one that rejects most bad ones.

Words are runs of anything but ASCII white space.  A null or empty text has no words and fails the base rules.  Rows are
judged alone: repeated rows get equal results, input order is of no account, other columns are ignored.  Without
labels the base rules alone decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SYMBOLS = b"#*$%&|<>"
UPPER, LOWER = bytes(range(65, 91)), bytes(range(97, 123))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("symbol_share", "mean_word", "dup_line_share", "repeat_share", "upper_share", "vocabulary")
MAX_LABELLED = 20_000


def _without(raw: bytes, kinds: bytes) -> int:
    return len(raw) - len(raw.translate(None, kinds))


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window which the text has at least twice."""
    n = len(words)
    if n < 4:
        return 0
    h = np.fromiter(map(hash, words), np.int64, n).astype(np.uint64)
    with np.errstate(over="ignore"):
        tri = (h[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ (h[1:-1] + np.uint64(0x7F4A7C15))) * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:]
    order = np.argsort(tri, kind="stable")
    same = tri[order[1:]] == tri[order[:-1]]
    found = np.zeros(n - 2, bool)
    found[order[1:][same]] = True
    found[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= found
    return int(covered.sum())


def measure(text: str | None) -> tuple[list[int], list[float]]:
    """The counts of COUNTS and the statistics of FEATURES."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n = len(words)
    word_chars = len(text) - _without(raw, common.WHITE)
    counts = [n, word_chars, _without(raw, SYMBOLS), len(lines) - len(set(lines)), repeated_words(words)]
    chars, m = max(word_chars, 1), max(n, 1)
    upper, lower = _without(raw, UPPER), _without(raw, LOWER)
    return counts, [
        counts[2] / chars, chars / m, counts[3] / max(len(lines), 1), counts[4] / m, upper / max(upper + lower, 1), len(set(words)) / m**0.9,
    ]


def base_failed(counts: np.ndarray) -> np.ndarray:
    return (counts[:, 0] < 50) | (100 * counts[:, 4] > 50 * counts[:, 0])


class IsolationForest:
    """Trees over random subsamples, split at random on a random feature, kept as heap-ordered arrays.

    A cut may fall up to ``margin`` beyond what a node's rows span, into empty space: a value that no row has then ends in
    an empty, shallow leaf, also where all rows share one value (no symbols at all, say).
    """

    def __init__(self, rows: np.ndarray, margin: np.ndarray, trees: int = 200, sample: int = 256, seed: int = 7):
        self.margin = margin
        rng, self.depth = np.random.default_rng(seed), int(np.ceil(np.log2(max(min(sample, len(rows)), 2))))
        size = 2 ** (self.depth + 1)
        self.feature, self.cut, self.path = np.zeros((trees, size), np.int32), np.full((trees, size), np.inf), np.zeros((trees, size))
        for t in range(trees):
            self._grow(rng, t, 1, 0, rows[rng.choice(len(rows), min(sample, len(rows)), replace=False)])
        self.norm = max(self._expected(min(sample, len(rows))), 1e-9)

    @staticmethod
    def _expected(n: int) -> float:
        return 0.0 if n < 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n

    def _grow(self, rng, t: int, node: int, depth: int, rows: np.ndarray) -> None:
        if depth == self.depth or len(rows) < 2:
            self.path[t, node] = depth + self._expected(len(rows))
            return
        f = rng.integers(rows.shape[1])
        cut = rng.uniform(rows[:, f].min() - self.margin[f], rows[:, f].max() + self.margin[f])
        self.feature[t, node], self.cut[t, node] = f, cut
        left = rows[:, f] < cut
        self._grow(rng, t, 2 * node, depth + 1, rows[left])
        self._grow(rng, t, 2 * node + 1, depth + 1, rows[~left])

    def score(self, rows: np.ndarray) -> np.ndarray:
        """0 to 1; higher: isolated after fewer splits."""
        total = np.zeros(len(rows))
        for t in range(len(self.path)):
            node = np.ones(len(rows), np.int64)
            for _ in range(self.depth):
                inner = np.isfinite(self.cut[t, node])
                right = rows[np.arange(len(rows)), self.feature[t, node]] >= self.cut[t, node]
                node = np.where(inner, 2 * node + right, node)
            total += self.path[t, node]
        return 2 ** (-total / len(self.path) / self.norm)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [measure(x) for x in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.list_(pa.int64())), pa.array([r[1] for r in rows], pa.list_(pa.float64())), batch.column("quality")], ["counts", "features", "quality"])


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_loss: float = 0.005) -> tuple[IsolationForest | None, float]:
    """The forest and the score from which on a document is rejected, from at most ``max_labelled`` labelled rows."""
    marked = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    got = common.labelled(docs, marked, "quality", max_labelled).select("text", "quality").mapInArrow(_measured, "counts array<long>, features array<double>, quality int").toPandas()  # at most max_labelled rows of counts
    if not len(got):
        return None, 2.0
    counts, features, good = np.array(got.counts.tolist()), np.array(got.features.tolist()), got.quality.to_numpy() == 1
    passed = ~base_failed(counts)
    if (good & passed).sum() < 20:
        return None, 2.0
    order = np.lexsort(features.T)  # the same rows in whatever order they came
    features, good, passed = features[order], good[order], passed[order]
    forest = IsolationForest(features[good & passed], np.ptp(features, axis=0) * 0.2 + 1e-9)
    fine, junk = np.sort(forest.score(features[good & passed])), forest.score(features[~good & passed])
    least = fine[min(len(fine) - 1, int(np.ceil((1 - max_loss) * len(fine))))] + 1e-9
    if not len(junk):
        return forest, float(least)
    caught = junk[junk > least]
    if not len(caught):
        return forest, float(least)
    # towards the junk, as far as nine tenths of what the cut catches stay well above it: good rows get the margin
    return forest, float(least + 0.5 * max(0.0, np.quantile(caught, 0.05) - least))


def judge(docs: DataFrame, model: tuple[IsolationForest | None, float], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns of every row, then COUNTS, base_failed, score and kept."""
    forest, cut = model
    kept_fields = [docs.schema[c] for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(x) for x in batch.column("_text").to_pylist()]
            if not rows:
                continue
            counts, features = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
            failed = base_failed(counts)
            score = forest.score(features) if forest else np.zeros(len(rows))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep] + [pa.array(counts[:, i], pa.int64()) for i in range(len(COUNTS))] + [pa.array(failed), pa.array(score), pa.array(~failed & (score < cut))],
                [*keep, *COUNTS, "base_failed", "score", "kept"],
            )

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept_fields] + [f"{c} long" for c in COUNTS] + ["base_failed boolean", "score double", "kept boolean"])
    return docs.select(*(F.col(f"`{c}`") for c in keep), F.col("text").cast("string").alias("_text")).mapInArrow(run, schema)


def filtered(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, unchanged, whose documents are kept."""
    columns = docs.columns
    wrapped = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("_row"), "text")
    kept = judge(wrapped, fit(docs, labels), keep=("_row",)).where("kept")
    return kept.select("_row.*")
