"""Quality classifier: a weak-label model teaches a hashed linear scorer.

Overlapping heuristic labellers vote low, high or abstain on every document. Their votes are counted
by pattern over all documents, expectation-maximisation on those counts estimates each labeller's
accuracy without true labels, and the posterior labels of a bounded sample train a linear scorer on
hashed features, which then scores every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .minhash import chunks, hashed_words, mix

ABSTAIN, LOW, HIGH = 0, 1, 2
_U = np.uint64


@dataclass(frozen=True)
class Labeller:
    """Votes low outside ``fair`` widened to ``poor``, high inside ``fair``, else abstains; needs
    ``least`` of its units (words, letters or lines) to vote at all."""

    name: str
    fair: tuple[float, float]
    poor: tuple[float, float]
    unit: str
    least: int


#: Statistics and the ranges in which each labeller calls them fair, and beyond which poor.
LABELLERS = (
    Labeller("symbols", (0.0, 0.008), (0.0, 0.02), "words", 1),
    Labeller("capitals", (0.0, 0.15), (0.0, 0.3), "letters", 30),
    Labeller("symbol_words", (0.0, 0.01), (0.0, 0.06), "words", 5),
    Labeller("repeated_trigrams", (0.0, 0.1), (0.0, 0.25), "words", 24),
    Labeller("distinct_words", (0.55, 1.0), (0.4, 1.0), "words", 12),
    Labeller("doubled_words", (0.0, 0.05), (0.0, 0.2), "words", 6),
    Labeller("word_length", (4.2, 5.9), (3.5, 7.0), "words", 20),
    Labeller("repeated_lines", (0.0, 0.34), (0.0, 0.5), "lines", 3),
)

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[*b"#$%&*\\^`{|}~[]!"]] = True
_PLACE = mix(np.arange(1, 4, dtype=_U)) | _U(1)
WORD_BUCKETS, BINS = 2048, 16
#: Word buckets, last bytes of words, bins of each statistic, and the constant.
FEATURES = WORD_BUCKETS + 256 + BINS * len(LABELLERS) + 1


def _distinct(x: np.ndarray) -> float:
    return len(np.unique(x)) / len(x) if len(x) else 1.0


def _describe(text: bytes, words: np.ndarray) -> tuple[np.ndarray, dict[str, int], np.ndarray]:
    """The labellers' statistics, their units, and counts of the words' last bytes."""
    data = np.frombuffer(text, np.uint8)
    counts = np.bincount(data, minlength=256)
    space = counts[[32, 9, 10, 11, 12, 13]].sum()
    full = max(1, len(data) - space)
    upper, lower = counts[65:91].sum(), counts[97:123].sum()
    gap = np.isin(data, np.array([32, 9, 10, 11, 12, 13], np.uint8))
    last = np.bincount(data[np.flatnonzero(~gap & np.concatenate((gap[1:], [True])))], minlength=256)
    n = len(words)
    trigrams = mix(words[:-2] * _PLACE[0] + words[1:-1] * _PLACE[1] + words[2:] * _PLACE[2]) if n > 2 else words[:0]
    lines = [x for x in text.split(b"\n") if x.strip()]
    stats = np.array([
        counts[_SYMBOLS].sum() / full,
        upper / max(1, upper + lower),
        last[_SYMBOLS].sum() / max(1, n),
        1 - _distinct(trigrams),
        _distinct(words) if n < 400 else np.mean([_distinct(words[i : i + 200]) for i in (*range(0, n - 199, 200), *([n - 200] if n % 200 else []))]),
        float((words[1:] == words[:-1]).mean()) if n > 1 else 0.0,
        full / max(1, n),
        1 - len(set(lines)) / len(lines) if lines else 0.0,
    ])
    return stats, {"words": n, "letters": int(upper + lower), "lines": len(lines)}, last


def votes(stats: np.ndarray, units: dict[str, int]) -> int:
    """All votes as one number, base 3."""
    pattern = 0
    for labeller, x in zip(LABELLERS, stats, strict=True):
        vote = ABSTAIN
        if units[labeller.unit] >= labeller.least:
            vote = HIGH if labeller.fair[0] <= x <= labeller.fair[1] else ABSTAIN if labeller.poor[0] <= x <= labeller.poor[1] else LOW
        pattern = 3 * pattern + vote
    return pattern


def _features(stats: np.ndarray, units: dict[str, int], words: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of a document's features; word and last-byte features are shares."""
    n = max(1, len(words))
    buckets, counts = np.unique((words >> _U(20)) % _U(WORD_BUCKETS), return_counts=True)
    ends = np.flatnonzero(last)
    span = np.array([(lab.poor[0] - (lab.poor[1] - lab.poor[0]) / 2, lab.poor[1] + (lab.poor[1] - lab.poor[0]) / 2) for lab in LABELLERS])
    place = np.clip((stats - span[:, 0]) / (span[:, 1] - span[:, 0]) * (BINS - 1), 0, BINS - 2).astype(int)
    place[[units[lab.unit] < lab.least for lab in LABELLERS]] = BINS - 1
    base = WORD_BUCKETS + 256
    index = np.concatenate((buckets.astype(np.int64), WORD_BUCKETS + ends, base + BINS * np.arange(len(LABELLERS)) + place, [FEATURES - 1]))
    value = np.concatenate((counts / n, last[ends] / n, np.ones(len(LABELLERS) + 1)))
    return index, value


def fit_labellers(counts: dict[int, int], rounds: int = 200) -> tuple[float, np.ndarray]:
    """Expectation-maximisation on counts of vote patterns: the share of high documents and
    P(vote | class) as an array (labeller, class low/high, vote). Starts from the majority of the
    votes and stops when the estimates don't move."""
    m = len(LABELLERS)
    patterns = np.array(sorted(counts))
    n = np.array([counts[p] for p in patterns.tolist()], float)
    vote = (patterns[:, None] // 3 ** np.arange(m - 1, -1, -1)) % 3
    low = (vote == LOW).any(axis=1)
    high = np.where(low, 0.1, 0.9)
    prior, table = 0.5, np.full((m, 2, 3), 1 / 3)
    for _ in range(rounds):
        weight = np.stack(((1 - high) * n, high * n))
        prior = (weight[1].sum() + 1) / (n.sum() + 2)
        new = np.stack([[np.bincount(vote[:, j], weight[c], 3) for c in (0, 1)] for j in range(m)]) + 0.1
        new /= new.sum(axis=2, keepdims=True)
        high = _posterior(vote, prior, new)
        if np.abs(new - table).max() < 1e-9:
            break
        table = new
    return float(prior), table


def _posterior(vote: np.ndarray, prior: float, table: np.ndarray) -> np.ndarray:
    """Abstentions say nothing; votes weigh by how much likelier they are in one class."""
    given = table[:, :, 1:] / table[:, :, 1:].sum(axis=2, keepdims=True)
    logs = np.concatenate((np.zeros((*given.shape[:2], 1)), np.log(given)), axis=2)
    score = np.stack([sum(logs[j, c][vote[:, j]] for j in range(vote.shape[1])) for c in (0, 1)])
    score += np.log([[1 - prior], [prior]])
    return 1 / (1 + np.exp(np.clip(score[0] - score[1], -500, 500)))


def posteriors(counts: dict[int, int]) -> dict[int, float]:
    """P(high) of each vote pattern; one without any vote has the prior."""
    prior, table = fit_labellers(counts)
    patterns = np.array(sorted(counts))
    vote = (patterns[:, None] // 3 ** np.arange(len(LABELLERS) - 1, -1, -1)) % 3
    return dict(zip(patterns.tolist(), _posterior(vote, prior, table).tolist(), strict=True))


def fit_scorer(rows: list[tuple[list[int], list[float], float]], rounds: int = 300, ridge: float = 1e-4, copies: list[int] | None = None) -> np.ndarray:
    """Weights of a logistic scorer by accelerated gradient steps on soft labels; a row counts as
    often as it has copies."""
    x = np.zeros((len(rows), FEATURES), np.float32)
    y = np.array([r[2] for r in rows], np.float32)
    n = np.array(copies or [1] * len(rows), np.float64)
    share = (n / n.sum()).astype(np.float32) if len(rows) else n
    for i, (index, value, _) in enumerate(rows):
        x[i, index] = value
    w, before = np.zeros(FEATURES, np.float32), np.zeros(FEATURES, np.float32)
    rate = np.float32(4.0 / (len(LABELLERS) + 3))
    for k in range(rounds if len(rows) else 0):
        ahead = w + (w - before) * np.float32(k / (k + 3))
        p = 1 / (1 + np.exp(-np.clip(x @ ahead, -30, 30)))
        grad = x.T @ ((p - y) * share) + np.float32(ridge) * ahead
        before, w = w, ahead - rate * grad
    return w


def _described(batch: pa.RecordBatch, column: int) -> Iterator[tuple]:
    for at, texts in chunks(batch, column):
        for i, (text, words) in enumerate(zip(texts, hashed_words(texts), strict=True)):
            yield at + i, words, *_describe(text, words)


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([votes(stats, units) for _, _, stats, units, _ in _described(batch, 0)], pa.int32())], names=["pattern"])


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [(votes(stats, units), *_features(stats, units, words, last)) for _, words, stats, units, last in _described(batch, 0)]
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.list_(pa.int64())), pa.array([o[2] for o in out], pa.list_(pa.float64()))], names=["copies", "pattern", "index", "value"])


@dataclass(frozen=True)
class QualityModel:
    posterior: dict[int, float]
    weights: np.ndarray

    def score(self, stats: np.ndarray, units: dict[str, int], words: np.ndarray, last: np.ndarray) -> float:
        if not len(words):
            return 0.0
        index, value = _features(stats, units, words, last)
        return float(1 / (1 + np.exp(-np.clip(np.dot(self.weights[index], value), -30, 30))))


def fit(docs: DataFrame, sample: int = 4096, text_col: str = "text") -> QualityModel:
    """The labellers from the votes of all documents (the driver gets at most 3**8 pattern counts),
    the scorer from the ``sample`` distinct texts of smallest hash, or all if there are fewer, each
    with its number of copies as weight."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    patterns = docs.select(text.alias("text")).mapInArrow(_vote, "pattern int").groupBy("pattern").count().collect()
    counts = {r["pattern"]: r["count"] for r in patterns}
    high = posteriors(counts) if counts else {}
    spark = docs.sparkSession
    smallest = docs.select(F.xxhash64(text).alias("_key")).groupBy("_key").count().orderBy(F.shiftrightunsigned("_key", 1), "_key").limit(sample).collect()
    keys = F.broadcast(spark.createDataFrame([tuple(r) for r in smallest], "_key bigint, copies bigint"))
    taken = docs.select(text.alias("text")).withColumn("_key", F.xxhash64("text")).join(keys, "_key").groupBy("_key").agg(F.min("text").alias("text"), F.first("copies").alias("copies"))
    rows = taken.select("text", "copies").mapInArrow(_featurise, "copies bigint, pattern int, index array<bigint>, value array<double>").collect()
    rows.sort(key=lambda r: (r["pattern"], r["index"], r["value"]))
    return QualityModel(high, fit_scorer([(r["index"], r["value"], high[r["pattern"]]) for r in rows], copies=[r["copies"] for r in rows]))


def quality_scores(docs: DataFrame, model: QualityModel | None = None, threshold: float = 0.5, sample: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, votes, posterior, score and kept (score of at least threshold) of every document.

    votes has the labellers' votes in base 3, posterior is the weak-label model's probability of
    high quality, score the trained scorer's. A null or empty text, or one without words, scores 0
    and isn't kept. Repeated rows repeat their result, null ids are passed on, other columns are
    ignored, and an empty table gives an empty result. No shuffle; the model's size is fixed.
    """
    model = model or fit(docs, sample, text_col)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(votes(stats, units), model.score(stats, units, words, last)) for _, words, stats, units, last in _described(batch, 1)]
            pattern, score = [o[0] for o in out], [o[1] for o in out]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(pattern, pa.int32()), pa.array([model.posterior.get(p) for p in pattern], pa.float64()), pa.array(score, pa.float64()), pa.array([s >= threshold for s in score], pa.bool_())],
                names=["doc_id", "votes", "posterior", "score", "kept"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(scored, "doc_id bigint, votes int, posterior double, score double, kept boolean")


def keep_good(docs: DataFrame, threshold: float = 0.5, sample: int = 4096, text_col: str = "text") -> DataFrame:
    """The rows of docs that the scorer keeps, with their own columns; no shuffle or join."""
    model = fit(docs, sample, text_col)
    place = docs.columns.index(text_col)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [at for at, words, stats, units, last in _described(batch, place) if model.score(stats, units, words, last) >= threshold]
            yield batch.take(pa.array(rows, pa.int64()))

    return docs.mapInArrow(kept, docs.schema)
