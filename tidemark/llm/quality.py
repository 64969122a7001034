"""Quality classifier: ordinal cumulative-link regression on graded ratings over hashed text.

P(grade <= j) = sigmoid(threshold_j - score): all thresholds share one weight per hashed feature. Features are the words of
a text (present or not), the shapes of its words with their share of the text, and how much it repeats itself. A first pass
over the sample keeps the features whose presence goes with the grade; rare words, of which every text has many, would
only add noise. Copies of a text count once.

Toxic is no place between poor and clean: on one axis few insults cannot outweigh the many words of good prose. So a second
model of the same kind, of the mark "toxic" alone, scores the same features, and a document is kept only if both say so.

The model is fitted in one task on a sample of rated documents whose size is bounded by a parameter. Scoring needs no
shuffle: the model, bounded too, travels with the tasks.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.text import key_of, plain_names, text_of

#: Hashed features, features kept by the first pass, and rated documents that a fit takes at most.
DIMENSIONS, KEPT, SAMPLE = 1 << 21, 4096, 20_000
#: How far presence has to depart from independence of the grade, in standard deviations, to be kept.
DEPARTURE = 7
#: The same for the mark "toxic", which few words carry, the rarer ones of some languages among them.
HARM_DEPARTURE = 5
#: How many times as often, or as seldom, a kept feature is present in some grade as in the others.
LIFT = 3
STEPS, RATE, SHRINK = 800, 0.1, 1e-6
_SHAPES = [(re.compile(r"[^\W\d_]+"), "a"), (re.compile(r"\d+"), "0")]
#: Shares of a text at which the share of a word shape counts as more.
SHARES = np.array([0.01, 0.03, 0.1, 0.3, 0.6])


@dataclass(frozen=True)
class OrdinalModel:
    features: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= j) for j = 1, 2, ...: one column per threshold."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -60, 60)))


def _shape(word: str) -> str:
    if word.isupper() and len(word) > 2:
        return "A" + _SHAPES[0][0].sub("", word)
    for pattern, mark in _SHAPES:
        word = pattern.sub(mark, word)
    return word[:8]


class Featurizer:
    """Sorted distinct feature numbers of a text; the same for all tasks."""

    def __init__(self):
        self.words: dict[str, tuple[int, str]] = {}

    def of(self, text: str | None) -> np.ndarray:
        words = (text or "").split()
        known = self.words
        if len(known) > 300_000:
            known.clear()
        counts = Counter(words)
        shapes: Counter[str] = Counter()
        out = []
        for word, n in counts.items():
            found = known.get(word)
            if found is None:
                bare = word.lower().strip(".,;:!?\"'()")
                found = known[word] = (xxhash.xxh3_64_intdigest(bare) % DIMENSIONS, _shape(word))
            out.append(found[0])
            shapes[found[1]] += n
        # Shares of the text: each shape of words, the most frequent word, and how many words are distinct.
        shares = dict(shapes)
        if words:
            shares |= {"\0most": max(counts.values()), "\0distinct": len(counts)}
        for name, n in shares.items():
            level = int(np.searchsorted(SHARES, n / len(words), side="right"))
            out.append(xxhash.xxh3_64_intdigest(f"\0{name}\0{level}") % DIMENSIONS)
        if not words:
            out.append(xxhash.xxh3_64_intdigest("\0empty") % DIMENSIONS)
        return np.unique(np.array(out, np.int64))


def _informative(features: list[np.ndarray], grades: np.ndarray, levels: int, departing: float) -> np.ndarray:
    """Features that are present in some grade more or less often than chance allows, the strongest first."""
    flat = np.concatenate(features)
    owners = np.repeat(grades, [len(f) for f in features])
    present = np.stack([np.bincount(flat[owners == g], minlength=DIMENSIONS) for g in range(levels)])
    sizes = np.bincount(grades, minlength=levels).astype(float)
    total, n = present.sum(axis=0), len(grades)
    strength = np.zeros(DIMENSIONS)
    for g in range(levels):
        expected = total * sizes[g] / n
        spread = np.sqrt(np.maximum(expected * (1 - sizes[g] / n) * (1 - total / n), 1e-9))
        # Half a count towards the expected one, so that single appearances of a rare feature in a rare grade do not count.
        departure = np.maximum(np.abs(present[g] - expected) - 0.5, 0) / np.maximum(spread, 0.3)
        inside, outside = (present[g] + 1) / (sizes[g] + 2), (total - present[g] + 1) / (n - sizes[g] + 2)
        strength = np.maximum(strength, np.where(np.maximum(inside / outside, outside / inside) >= LIFT, departure, 0))
    strength[total < 5] = 0
    best = np.argsort(-strength, kind="stable")[:KEPT]
    return np.sort(best[strength[best] >= departing])


def fit_arrays(features: list[np.ndarray], grades: np.ndarray, levels: int, departing: float = DEPARTURE) -> OrdinalModel:
    """Penalised maximum likelihood by Adam steps over the whole sample; no randomness."""
    kept = _informative(features, grades, levels, departing)
    at = [np.searchsorted(kept, f[np.isin(f, kept, assume_unique=True)]) for f in features]
    columns = np.concatenate(at) if at else np.zeros(0, np.int64)
    rows = np.repeat(np.arange(len(at)), [len(a) for a in at])
    n, m = len(grades), len(kept)
    shares = np.clip(np.array([(grades <= j).mean() for j in range(levels - 1)]), 1e-3, 1 - 1e-3)
    base = np.log(shares / (1 - shares))
    gaps = np.log(np.maximum(np.diff(base), 1e-2))
    theta = np.concatenate([np.zeros(m), base[:1], gaps])
    one, two = np.zeros_like(theta), np.zeros_like(theta)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -60, 60)))
    for step in range(1, STEPS + 1):
        scores = np.bincount(rows, theta[:m][columns], n)
        gaps = np.exp(theta[m + 1 :])
        cuts = np.concatenate([[-np.inf], theta[m] + np.concatenate([[0.0], np.cumsum(gaps)]), [np.inf]])
        upper, lower = sigmoid(cuts[grades + 1] - scores), sigmoid(cuts[grades] - scores)
        chance = np.maximum(upper - lower, 1e-12)
        up, down = upper * (1 - upper) / chance, lower * (1 - lower) / chance
        by_cut = np.bincount(grades + 1, up, levels + 1) - np.bincount(grades, down, levels + 1)  # d log likelihood / d cut
        inner = by_cut[1:levels]
        later = np.cumsum(inner[::-1])[::-1]
        gradient = np.concatenate([np.bincount(columns, (down - up)[rows], m), later[:1], later[1:] * gaps]) / n
        gradient[:m] -= SHRINK * theta[:m]
        one = 0.9 * one + 0.1 * gradient
        two = 0.999 * two + 0.001 * gradient**2
        theta = theta + RATE * (one / (1 - 0.9**step)) / (np.sqrt(two / (1 - 0.999**step)) + 1e-8)
    cuts = theta[m] + np.concatenate([[0.0], np.cumsum(np.exp(theta[m + 1 :]))])
    return OrdinalModel(kept, theta[:m], cuts)


def _featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    featurizer = Featurizer()
    for batch in batches:
        rows = [featurizer.of(text) for text in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int64()))], names=["grade", "features"])


def fit(
    documents: DataFrame, ratings: DataFrame, levels: int, sample: int = SAMPLE, id_column: str = "doc_id", text_column: str = "text",
    departing: float = DEPARTURE,
) -> OrdinalModel | None:
    """A model from ``ratings`` (``doc_id``, ``grade`` in [0, levels)) of at most ``sample`` documents, chosen by a hash of the id.

    Ratings with a null id or grade, or out of range, are left out; of several ratings of a document all count. None if
    nothing is rated.
    """
    rated = ratings.where(F.col("grade").between(0, levels - 1)).select(key_of("doc_id").alias("__rated"), F.col("grade").cast("int").alias("__grade"))
    chosen = rated.where(F.col("__rated") > -(2**63)).orderBy(F.xxhash64("__rated"), "__rated", "__grade").limit(sample)
    # At most ``sample`` rows of two numbers.
    rows = documents.select(key_of(id_column).alias("__rated"), text_of(text_column).alias("__text")).join(F.broadcast(chosen), "__rated")

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [pa.Table.from_batches([b]) for b in batches]
        features = [np.asarray(f, np.int64) for t in tables for f in t.column("features").to_pylist()]
        grades = np.concatenate([t.column("grade").to_numpy() for t in tables]).astype(np.int64) if tables else np.zeros(0, np.int64)
        if len(grades):
            # Copies count once, and the order of the rows must not matter for the sums.
            order = sorted({(int(g), f.tobytes()): i for i, (g, f) in enumerate(zip(grades, features, strict=True))}.items())
            order = np.array([i for _, i in order])
            model = fit_arrays([features[i] for i in order], grades[order], levels, departing)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x]) for x in (model.features, model.weights, model.thresholds)], names=["features", "weights", "thresholds"]
            )

    found = (
        rows.select("__grade", "__text").mapInArrow(_featurize, "grade int, features array<long>")
        .repartition(1).mapInArrow(train, "features array<long>, weights array<double>, thresholds array<double>")
        .collect()
    )
    return OrdinalModel(*[np.array(found[0][name]) for name in ("features", "weights", "thresholds")]) if found else None


@plain_names
def score(documents: DataFrame, model: OrdinalModel | None, text_column: str = "text", harm: OrdinalModel | None = None) -> DataFrame:
    """``documents`` with ``expected_grade``, ``tail`` (P of the highest grade) and ``harmless`` (the same of ``harm``), all double.

    What comes from a model that is None is null. A null or empty text is scored by the one feature "empty". Columns of
    these names are replaced.
    """
    added = ("expected_grade", "tail", "harmless")
    kept = [c for c in documents.columns if c.lower() not in added]
    rows = documents.select(*[f"`{c}`" for c in kept])
    if model is None and harm is None:
        return rows.withColumns({c: F.lit(None).cast("double") for c in added})
    at = [c.lower() for c in kept].index(text_column.lower())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        featurizer = Featurizer()
        dense = np.zeros((DIMENSIONS, 2))
        for column, one in enumerate((model, harm)):
            if one is not None:
                dense[one.features, column] = one.weights
        for batch in batches:
            scores = np.array([dense[featurizer.of(text)].sum(axis=0) for text in batch.column(at).to_pylist()]).reshape(-1, 2)
            grade = tail = harmless = pa.nulls(batch.num_rows, pa.float64())
            if model is not None:
                tails = model.tails(scores[:, 0])
                grade, tail = pa.array(tails.sum(axis=1)), pa.array(tails[:, -1].copy())
            if harm is not None:
                harmless = pa.array(harm.tails(scores[:, 1])[:, -1].copy())
            yield pa.RecordBatch.from_arrays([*batch.columns, grade, tail, harmless], names=[*kept, *added])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *[T.StructField(c, T.DoubleType()) for c in added]]))


def score_marks(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``score`` by two models fitted on the marks of ``labels``: the three grades, and the mark "toxic" alone."""
    model = fit(documents, grades_of(labels), levels=3)
    harm = fit(documents, harmless_of(labels), levels=2, departing=HARM_DEPARTURE)
    return score(documents, model, harm=harm)


def grades_of(labels: DataFrame) -> DataFrame:
    """Three grades out of two marks: 0 poor, 1 toxic though well written, 2 clean. A null mark gives no grade."""
    grade = F.when(F.col("quality") == 0, 0).when((F.col("quality") == 1) & (F.col("toxic") == 1), 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)
    return labels.select("doc_id", grade.alias("grade"))


def harmless_of(labels: DataFrame) -> DataFrame:
    """Grade 0 for toxic and 1 for not toxic, whatever the quality. A null mark gives no grade."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, 0).when(F.col("toxic") == 0, 1).alias("grade"))


def keep_clean(scored: DataFrame, least: float = 0.5) -> Column:
    """Whether the highest grade and being harmless are each at least as likely as ``least``; what has no score does not count."""
    return F.coalesce(scored["tail"] >= least, F.lit(True)) & F.coalesce(scored["harmless"] >= least, F.lit(True))
