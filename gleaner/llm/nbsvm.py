"""Quality classifier: Naive Bayes support vectors over token n-grams.

Tokens are runs of word bytes and runs of other printable bytes. A text's features are
indicators of its token unigrams and bigrams and of the bigrams of its tokens' shapes
(capitals, capitalised, small, digits, signs) and of a token's repetition, hashed to one table. Indicators are scaled by
the log-count ratio of the two classes and the row is brought to length one; a linear
model with hinge loss is fitted by dual coordinate descent, and its margin becomes a
probability by a logistic curve fitted on margins of rows that the model had not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gleaner.llm.textvec import CHUNK_BYTES, IS_SPACE, crc32_text, prefix_hash, span_hash, stretches, text_chunks
from gleaner.session import materialise

TABLE_BITS = 18
MAX_TRAIN_ROWS = 8000  # labelled rows that the model is fitted on, at most
MAX_TRAIN_FEATURES = 6_000_000  # and their features together
THRESHOLD = 0.7
SMOOTH = 1.0
COST = 1.0
EPOCHS = 8
FOLDS = 4  # of the margins for the curve
LAST = 4  # tokens before the last one that a feature may take in

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_KIND = np.where(IS_SPACE, 0, np.where(_WORD, 1, 2)).astype(np.uint8)
_PAIR = np.uint64(0xA24BAED4963EE407)
_SHAPE = np.uint64(0x9FB21C651E98DF25)


class Model(NamedTuple):
    """``weights``: the linear model times the ratios; ``ratios``: log-count ratios; then bias, and slope and offset of the curve."""

    weights: np.ndarray
    ratios: np.ndarray
    bias: float
    slope: float
    offset: float


def features(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, table slot) of every distinct feature of each row, by row. A long text alone is read a stretch at a time, each with the last tokens
    before it: features are indicators, so what two stretches share counts once."""
    if len(offsets) > 2 or len(buf) <= CHUNK_BYTES:
        return _features(buf, offsets)
    held, begin = np.zeros(1 << TABLE_BITS, bool), 0
    for _, b in stretches(buf, IS_SPACE):
        held[_features(buf[begin:b], np.array([0, b - begin]))[1]] = True
        starts = _tokens(buf[begin:b], np.array([0, b - begin]))[0]
        begin += int(starts[-LAST]) if len(starts) >= LAST else 0
    slot = np.flatnonzero(held)
    return np.zeros(len(slot), np.int64), slot


def _tokens(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and kinds of the tokens."""
    kind = _KIND[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offsets] = True
    edge[1 : len(buf)] |= kind[1:] != kind[:-1]
    cuts = np.flatnonzero(edge)
    on = kind[cuts[:-1]] > 0
    return cuts[:-1][on], cuts[1:][on], kind[cuts[:-1][on]]


def _features(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts, ends, kind = _tokens(buf, offsets)
    row = np.searchsorted(offsets, starts, "right") - 1
    token = span_hash(prefix_hash(buf), starts, ends)
    capitals = np.concatenate([[0], np.cumsum(_UPPER[buf])])
    many = capitals[ends] - capitals[starts]
    length = ends - starts
    shape = np.where(kind == 2, 4, np.where(_DIGIT[buf[starts]], 3, np.where((many == length) & (length > 1), 0, np.where(_UPPER[buf[starts]], 1, 2))))
    together = row[1:] == row[:-1]
    pair = (token[:-1] * _PAIR ^ token[1:])[together]
    shapes = ((shape[:-1] * 5 + shape[1:]).astype(np.uint64) + np.uint64(1))[together] * _SHAPE
    every, of = [token, pair * _SHAPE, shapes * _PAIR], [row, row[1:][together], row[1:][together]]
    for lag in (1, 2):  # the n-gram of one token three times over, in a row or with others between
        again = np.flatnonzero((token[: -2 * lag] == token[lag:-lag]) & (token[lag:-lag] == token[2 * lag :]) & (row[: -2 * lag] == row[2 * lag :]))
        every.append((shape[again] * 2 + lag).astype(np.uint64) * _SHAPE * _PAIR)
        of.append(row[again])
    every, of = np.concatenate(every) >> np.uint64(64 - TABLE_BITS), np.concatenate(of).astype(np.uint64)
    key = np.unique(of << np.uint64(TABLE_BITS) | every).astype(np.int64)
    return key >> TABLE_BITS, key & ((1 << TABLE_BITS) - 1)


def log_count_ratios(slots: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """Log of the classes' smoothed shares of each slot; ``positive`` tells each feature's class."""
    size = 1 << TABLE_BITS
    p = SMOOTH + np.bincount(slots[positive], minlength=size)
    q = SMOOTH + np.bincount(slots[~positive], minlength=size)
    return np.log(p / p.sum()) - np.log(q / q.sum())


def coordinate_descent(slots: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: float = COST, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise |w|^2/2 + cost * sum of hinge losses, over rows of length one and a constant feature.

    Rows are visited in a fixed shuffled order.
    """
    w, bias = np.zeros(1 << TABLE_BITS), 0.0
    alpha = np.zeros(len(y))
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)):
            s, v = slots[i], values[i]
            g = y[i] * (w[s] @ v + bias) - 1
            old = alpha[i]
            new = min(max(old - g / 2.0, 0.0), cost)  # a row's squared length is 1, and 1 of the constant
            if new != old:
                step = (new - old) * y[i]
                w[s] += step * v
                bias += step
                alpha[i] = new
                moved = max(moved, abs(new - old))
        if moved < 1e-3:
            break
    return w, bias


def _unit(slots: list[np.ndarray], ratios: np.ndarray) -> list[np.ndarray]:
    out = []
    for s in slots:
        v = ratios[s]
        out.append((v / (np.sqrt(v @ v) or 1.0)).astype(np.float32))
    return out


def _curve(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve, by Newton's method on softened targets."""
    pos, neg = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    ab = np.array([1.0, 0.0])
    x = np.stack([margin, np.ones_like(margin)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ ab, -30, 30)))
        grad = x.T @ (p - target) + 1e-3 * (ab - [1.0, 0.0])
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        ab -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return max(float(ab[0]), 1e-3), float(ab[1])


def train(slots: list[np.ndarray], labels: np.ndarray) -> Model:
    """Fit on rows of distinct slots with labels 0 or 1. Without both classes every score is the share of label 1 (0.5 if none)."""
    y = np.where(np.asarray(labels) > 0, 1.0, -1.0)
    size = 1 << TABLE_BITS
    pos, neg = int((y > 0).sum()), int((y < 0).sum())
    if not pos or not neg:
        share = (pos + 1) / (pos + neg + 2)
        return Model(np.zeros(size, np.float32), np.zeros(size, np.float32), 0.0, 1.0, float(np.log(share / (1 - share))))

    def fit(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        own = [slots[i] for i in rows]
        ratios = log_count_ratios(np.concatenate(own), np.repeat(y[rows] > 0, [len(s) for s in own]))
        w, bias = coordinate_descent(own, _unit(own, ratios), y[rows])
        return w, ratios, bias

    fold = np.zeros(len(y), np.int64)
    for sign in (1, -1):
        own = np.flatnonzero(y == sign)
        fold[own] = np.arange(len(own)) % FOLDS
    margin = np.zeros(len(y))
    for k in range(FOLDS):
        w, ratios, bias = fit(np.flatnonzero(fold != k))
        for i in np.flatnonzero(fold == k):
            v = ratios[slots[i]]
            margin[i] = w[slots[i]] @ v / (np.sqrt(v @ v) or 1.0) + bias
    slope, offset = _curve(margin, y)
    w, ratios, bias = fit(np.arange(len(y)))
    return Model((w * ratios).astype(np.float32), ratios.astype(np.float32), bias, slope, offset)


def probabilities(row: np.ndarray, slot: np.ndarray, n: int, model: Model) -> np.ndarray:
    r = model.ratios[slot].astype(np.float64)
    dot = np.bincount(row, model.weights[slot], minlength=n)
    norm = np.sqrt(np.bincount(row, r * r, minlength=n))
    margin = dot / np.where(norm > 0, norm, 1) + model.bias
    return 1 / (1 + np.exp(-np.clip(model.slope * margin + model.offset, -30, 30)))


def _slot_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, buf, offsets in text_chunks(batch.column(2)):
            row, slot = features(buf, offsets)
            edges = pa.array(np.searchsorted(row, np.arange(b - a + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.ListArray.from_arrays(edges, pa.array(slot.astype(np.int32)))], ["key", "label", "slots"]
            )


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_TRAIN_ROWS, max_features: int = MAX_TRAIN_FEATURES) -> Model:
    """Fit on at most ``max_rows`` rows of ``df`` that ``labels`` marks 0 or 1, those whose ids hash lowest, up to ``max_features`` features. An id with
    both labels counts as 0; rows of one id and the same features count once."""
    marked = labels.where(labels[label_col].isin(0, 1)).select(labels[id_col].cast("long").alias("id"), labels[label_col].cast("int").alias("label"))
    chosen = marked.where("id is not null").groupBy("id").agg(F.min("label").alias("label")).withColumn("key", F.xxhash64("id")).orderBy("key", "id").limit(max_rows)
    texts = df.select(df[id_col].cast("long").alias("id"), df[text_col].cast("string").alias("text"))
    found = texts.join(F.broadcast(chosen), "id").select("key", "label", "text").mapInArrow(_slot_batches, "key long, label int, slots array<int>")
    found = materialise(found.withColumn("hash", F.xxhash64("slots")), "nbsvm-rows")
    size = found.select("key", "hash", F.size("slots").alias("size")).dropDuplicates(["key", "hash"]).orderBy("key", "hash").limit(max_rows).collect()
    total, cut = 0, None
    for r in size:
        total += r["size"]
        if cut is not None and total > max_features:  # a row alone has no more features than the table
            break
        cut = r
    if cut is None:
        return train([], np.zeros(0))
    got = found.where((F.col("key") < cut["key"]) | ((F.col("key") == cut["key"]) & (F.col("hash") <= cut["hash"]))).dropDuplicates(["key", "hash"]).orderBy("key", "hash").toArrow()
    slots = [np.asarray(x, np.int32) for x in got.column("slots").combine_chunks().to_numpy(zero_copy_only=False)]
    return train(slots, got.column("label").to_numpy())


def classify(df: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD, score_col: str = "quality_score", pred_col: str = "quality_pred") -> DataFrame:
    """Add ``score_col`` (0 to 1, higher: label 1 likelier) and ``pred_col`` (1 from ``threshold`` on).

    Null and empty texts have the score that a text without features has. Texts are read whole; equal texts, equal scores;
    repeated rows stay; earlier columns of these names are replaced.
    """
    held = df.sparkSession.sparkContext.broadcast(model)
    kept = df.drop(score_col, pred_col)
    at = kept.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, offsets in text_chunks(batch.column(at)):
                score = probabilities(*features(buf, offsets), b - a, held.value)
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns), pa.array(score)], [*batch.schema.names, score_col])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    scored = kept.mapInArrow(run, f"{fields}, `{score_col}` double")
    return scored.withColumn(pred_col, (F.col(score_col) >= threshold).cast("int"))


def score(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learn from labelled rows whose crc32(id as text) mod 4 is not 2; return ``doc_id, held_out, score, predicted`` for every row.

    An empty table gives an empty result; without labels every text scores alike.
    """
    src = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text")).withColumn("held_out", F.expr(f"{crc32_text('doc_id')} % 4 = 2"))
    learn = labels.where(F.expr(f"{crc32_text(id_col)} % 4 <> 2"))
    model = fit(src, learn, "doc_id", "text")
    return classify(src, model).select("doc_id", "held_out", F.col("quality_score").alias("score"), F.col("quality_pred").alias("predicted"))
