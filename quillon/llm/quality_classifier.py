"""Quality classifier: cumulative-link (ordinal logistic) regression on graded ratings over hashed text."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from ._stage import drop, small_batches, staged, worker_state
from ._words import chunks, split_words

#: Hash buckets for words and for word shapes; together with the length features the size of the model.
BUCKETS = 1 << 18
SHAPES = 1 << 12
EXTRA = 7
#: Grades are 0 .. GRADES - 1.
GRADES = 3
#: Signs that prose seldom holds, digits and capitals, whose shares of a text are features.
SIGNS = (b"#*$%&|<>@^~{}[]\\=+_/", b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")
PREFIX = 5
_LOWER, _UPPER, _DIGIT = re.compile(rb"[a-z\x80-\xff]+"), re.compile(rb"[A-Z]+"), re.compile(rb"[0-9]+")
_EDGE = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def word_slot(word: bytes) -> int:
    """Bucket of a word, without case and without punctuation at its ends."""
    return xxh3_64_intdigest(word.lower().strip(_EDGE)) % BUCKETS


def shape_slot(word: bytes) -> int:
    """Bucket of a word's shape: runs of lower case, upper case and digits become one sign each."""
    shape = _DIGIT.sub(b"0", _UPPER.sub(b"A", _LOWER.sub(b"a", word)))
    return BUCKETS + xxh3_64_intdigest(shape[:12]) % SHAPES


def prefix_slot(word: bytes) -> int:
    """Bucket of a word's first letters, shared with the words."""
    own = word.decode(errors="replace").lower().strip(_EDGE.decode())
    return xxh3_64_intdigest(own[:PREFIX] + "*") % BUCKETS


def _whole(text: bytes, words: list[bytes], own: dict) -> tuple[float, ...]:
    """Share of repeated words, share of words equal to the one before, log length, shortness, and roots of the shares of SIGNS."""
    n = len(words)
    shares = [float(np.sqrt((len(text) - len(text.translate(None, signs))) / len(text))) for signs in SIGNS]
    return 1 - len(own) / n, sum(map(eq, words, words[1:])) / n, float(np.log1p(n)), n**-0.5, *shares


def features(text: bytes | None) -> tuple[list[int], list[float]]:
    """Different words and their beginnings count 1 each, their shapes by share; then what holds for the whole text."""
    words = split_words(text)
    own = dict.fromkeys(words)
    if not own:
        return [], []
    last = BUCKETS + SHAPES
    shapes = Counter(map(shape_slot, own))
    slots = [word_slot(w) for w in own] + [prefix_slot(w) for w in own] + list(shapes) + [last + i for i in range(EXTRA)]
    values = [1.0] * (2 * len(own)) + [n / len(own) for n in shapes.values()] + list(_whole(text, words, own))
    return slots, values


@dataclass
class OrdinalModel:
    """P(grade <= k) = sigmoid(thresholds[k] - weights . x)."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -60, 60)))


def fit_cumulative_link(
    rows: np.ndarray, slots: np.ndarray, values: np.ndarray, grades: np.ndarray, size: int, levels: int = GRADES, l2: float = 1e-4, steps: int = 400, rate: float = 0.05
) -> OrdinalModel:
    """Maximum likelihood with an L2 penalty, by full-batch Adam; ``rows``, ``slots``, ``values`` are the sparse matrix.

    There are ``levels`` - 1 thresholds whatever grades occur: above the highest
    one seen a tail is at most about 0.01.  Without rows all tails are 0.5.
    """
    n, cuts = len(grades), levels - 1
    if not n:
        return OrdinalModel(np.zeros(size, dtype=np.float32), np.zeros(cuts))
    share = [(grades > k).mean() for k in range(cuts)]
    theta = -np.log(np.clip(share, 0.01, 0.99) / (1 - np.clip(share, 0.01, 0.99)))
    theta = np.maximum.accumulate(theta + 1e-3 * np.arange(cuts))
    weights = np.zeros(size)
    params = [weights, theta]
    first, second = ([np.zeros_like(p) for p in params] for _ in range(2))
    one = np.eye(levels + 1)[grades]
    for step in range(1, steps + 1):
        score = np.bincount(rows, weights[slots] * values, minlength=n)
        edge = 1 / (1 + np.exp(np.clip(score[:, None] - theta[None, :], -60, 60)))
        full = np.concatenate([np.zeros((n, 1)), edge, np.ones((n, 1))], axis=1)
        p = np.maximum((np.diff(full, axis=1) * one[:, : cuts + 1]).sum(axis=1), 1e-12)
        slope = np.concatenate([np.zeros((n, 1)), edge * (1 - edge), np.zeros((n, 1))], axis=1)
        up = (slope[:, 1:] * one[:, : cuts + 1]).sum(axis=1)
        down = (slope[:, :-1] * one[:, : cuts + 1]).sum(axis=1)
        d_score = (up - down) / p / max(n, 1)
        d_theta = np.array([(slope[:, k + 1] * (one[:, k + 1] - one[:, k]) / p).sum() / max(n, 1) for k in range(cuts)])
        grads = [np.bincount(slots, d_score[rows] * values, minlength=size) + l2 * weights, d_theta]
        for i, grad in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * grad
            second[i] = 0.999 * second[i] + 0.001 * grad**2
            params[i] -= rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
        np.maximum.accumulate(theta, out=theta)
    return OrdinalModel(weights.astype(np.float32), theta)


def telling(n: np.ndarray, total: np.ndarray, docs: int, grades: float, variance: float, least_z: float) -> np.ndarray:
    """Whether the ``n`` texts with a feature, of grade sum ``total``, have another mean grade than the rest of the ``docs``."""
    inside, outside = np.maximum(n, 1), np.maximum(docs - n, 1)
    gap = total / inside - (grades - total) / outside
    error = np.sqrt(max(variance, 1e-12) * (1 / inside + 1 / outside))
    return (n < docs) & (np.abs(gap) >= least_z * error)


def fit_quality_model(docs: DataFrame, labels: DataFrame, sample: int = 16_384, least_share: float = 0.005, least_z: float = 4.0, seed: int = 1) -> OrdinalModel:
    """The model fitted on at most ``sample`` labelled documents, drawn by seeded hash of doc_id.

    A rating is graded 0 to 2: one point for quality, one for not being toxic;
    of several ratings of a document the lowest counts, ratings with a null do not.
    So a well-written toxic text and a clean poor one share the middle grade; selection
    by the tail of the highest grade rejects both.  Without any labelled text the model
    knows nothing: all tails are 0.5, and texts with words are kept.  Word
    buckets of fewer than 5 sampled documents, or ``least_share`` of them, get no weight,
    nor do those whose texts are graded like the rest (``least_z`` standard errors):
    a long text holds hundreds of words that say nothing.
    What reaches the driver is bounded by the sample and the model: three sums
    for each bucket, and the sample's (bucket, value) pairs in those that get a weight.

    Of several texts under one doc_id the least counts; null texts do not.
    """
    small_batches(docs.sparkSession)
    graded = staged(
        labels.where("doc_id is not null and quality is not null and toxic is not null")
        .groupBy("doc_id")
        .agg(F.min(F.col("quality") + 1 - F.col("toxic")).cast("int").alias("grade"))
        .orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id")
        .limit(sample),
        "graded",
    )
    pairs = "grade int, slots array<int>, values array<float>"
    schema = pa.schema([("grade", pa.int32()), ("slots", pa.list_(pa.int32())), ("values", pa.list_(pa.float32()))])

    def run(batches):
        worker_state("quality_classifier")
        for batch in batches:
            found = [features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("grade"),
                    pa.array([f[0] for f in found], pa.list_(pa.int32())),
                    pa.array([f[1] for f in found], pa.list_(pa.float32())),
                ],
                schema=schema,
            )

    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text")).where("text is not null")
    rows = staged(
        texts.join(F.broadcast(graded), "doc_id")  # ``sample`` rows at most
        .groupBy("doc_id")
        .agg(F.min("text").alias("text"), F.min("grade").alias("grade"))
        .select("grade", "text")
        .mapInArrow(run, pairs),
        "features",
    )
    whole = rows.agg(F.count("*").alias("docs"), F.sum("grade").alias("grades"), F.var_pop("grade").alias("variance")).first()
    counts = (
        rows.select("grade", F.explode("slots").alias("slot"))
        .groupBy("slot")
        .agg(F.count("*").alias("n"), F.sum("grade").alias("total"))
        .where(F.col("n") >= max(5, least_share * whole.docs))
        .toArrow()
    )
    slot, n, total = (counts.column(c).to_numpy() for c in ("slot", "n", "total"))
    size = BUCKETS + SHAPES + EXTRA
    known = np.zeros(size, dtype=bool)
    known[slot[(slot >= BUCKETS) | telling(n, total, whole.docs, whole.grades or 0, whole.variance or 0.0, least_z)]] = True

    def weighted(batches):
        for batch in batches:
            slots, values = [], []
            for own, value in zip(*(batch.column(c).to_numpy(zero_copy_only=False) for c in ("slots", "values")), strict=True):
                use = known[own] if len(own) else np.zeros(0, dtype=bool)
                slots.append(own[use])
                values.append(value[use])
            yield pa.RecordBatch.from_arrays(
                [batch.column("grade"), pa.array(slots, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))], schema=schema
            )

    found = rows.mapInArrow(weighted, pairs).toArrow()
    drop(graded, rows)
    grades = found.column("grade").to_numpy().astype(np.int64)
    slots, values = (np.concatenate([c.flatten().to_numpy() for c in found.column(n).chunks] or [np.zeros(0)]) for n in ("slots", "values"))
    owner = np.repeat(np.arange(len(grades)), pc.list_value_length(found.column("slots")).to_numpy())
    used = np.flatnonzero(known)
    small = fit_cumulative_link(owner, np.searchsorted(used, slots), values.astype(np.float64), grades, len(used))
    weights = np.zeros(size, dtype=np.float32)
    weights[used] = small.weights
    return OrdinalModel(weights, small.thresholds)


def score_quality(docs: DataFrame, model: OrdinalModel, least_tail: float = 0.5) -> DataFrame:
    """``docs`` with ``expected_grade``, ``tail_probability`` (of the highest grade) and ``kept`` (tail at ``least_tail`` or more).

    A null or empty text has no words: grade 0, tail 0, not kept.  Rows
    repeated whole get the same scores; other columns pass through, but for
    incoming ones of the three names, which are replaced.  An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    new = {"expected_grade": "double", "tail_probability": "double", "kept": "boolean"}
    docs = docs.drop(*new)
    names = [f"_c{i}" for i in range(len(docs.columns))]
    inner = docs.toDF(*names)
    text = names[docs.columns.index("text")]
    fields = [f"{c} {t.dataType.simpleString()}" for c, t in zip(names, docs.schema, strict=True)]
    weights = model.weights

    class Weights(dict):
        def __missing__(self, word: bytes) -> complex:
            if len(self) >= 400_000:
                self.clear()
            value = self[word] = complex(weights[word_slot(word)] + weights[prefix_slot(word)], weights[shape_slot(word)])
            return value

    def run(batches):
        worker_state("quality_classifier")
        held = Weights()
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            for a, b in chunks(texts):
                scores, empty = np.zeros(b - a), np.zeros(b - a, dtype=bool)
                for i, t in enumerate(texts[a:b]):
                    words = split_words(t)
                    own = dict.fromkeys(words)
                    if not own:
                        empty[i] = True
                        continue
                    both = sum(map(held.__getitem__, own))
                    scores[i] = both.real + both.imag / len(own) + np.dot(_whole(t, words, own), weights[-EXTRA:])
                tails = model.tails(scores)
                tails[empty] = 0
                columns = [batch.column(c).slice(a, b - a) for c in names]
                extra = [pa.array(tails.sum(axis=1)), pa.array(tails[:, -1]), pa.array(tails[:, -1] >= least_tail)]
                yield pa.RecordBatch.from_arrays(columns + extra, names=[*names, *new])

    out = inner.withColumn("_text", F.col(text).cast("binary")).mapInArrow(run, ", ".join(fields + [f"{c} {t}" for c, t in new.items()]))
    return out.select(*[F.col(i).alias(c) for i, c in zip(names, docs.columns, strict=True)], *new)
