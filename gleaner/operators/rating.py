"""Tournaments: Elo ratings folded from ordered action logs, with undo; pairs to compare next."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from gleaner.session import materialise

START = 1000


def elo(rating_a: int, rating_b: int, score_a: float, n_a: int, n_b: int) -> tuple[int, int]:
    """New ratings after one comparison; the step shrinks with the mean number of comparisons. Halves round up."""
    k = 32 / (1 + (n_a + n_b) / 2 / 10)
    expected = 1 / (1 + 10 ** ((rating_b - rating_a) / 400))
    up = lambda x: int((x + 0.5) // 1)
    return up(rating_a + k * (score_a - expected)), up(rating_b + k * ((1 - score_a) - (1 - expected)))


def fold_log(state: dict, actions: Iterable, history: list | None = None) -> dict:
    """Apply ``(a, b, score)`` actions in order to ``{item: [rating, comparisons, wins, losses]}``; ``score`` is None for undo of the last action.

    ``history`` holds what each action that can still be undone has replaced, and is kept up.
    """
    history = [] if history is None else history
    for a, b, score in actions:
        if score is None or score != score:
            if history:
                for item, old in history.pop().items():
                    state[item] = [old[0], *(max(x, 0) for x in old[1:])]
            continue
        x, y = state.setdefault(a, [START, 0, 0, 0]), state.setdefault(b, [START, 0, 0, 0])
        history.append({a: list(x), b: list(y)})
        ra, rb = elo(x[0], y[0], score, x[1], y[1])
        state[a] = [ra, x[1] + 1, x[2] + (score == 1), x[3] + (score == 0)]
        state[b] = [rb, y[1] + 1, y[2] + (score == 0), y[3] + (score == 1)]
    return state


def _fold_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fold the sorted sessions of a partition one after the other; only one session's state is held."""
    kinds = ["session", "item", "rating", "comparisons", "wins", "losses"]
    nothing = object()
    current, state, history, out = nothing, {}, [], []

    def table() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], kinds)

    for batch in batches:
        for session, a, b, score in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if session != current:
                out += [(current, item, *values) for item, values in sorted(state.items())]
                current, state, history = session, {}, []
            fold_log(state, [(a, b, score)], history)
        if len(out) > 10_000:
            yield table()
            out = []
    out += [(current, item, *values) for item, values in sorted(state.items())]
    if out:
        yield table()


def tournament(log: DataFrame) -> DataFrame:
    """``session, item, rating, comparisons, wins, losses`` from ``session, seq, a, b, score`` (1, 0.5, 0 for a; null: undo).

    Ratings depend on order, so each session's log is one sorted run within a partition: rows are dealt by session and folded as they
    come. Actions of equal ``seq`` go by ``a, b``.
    """
    rows = log.select("session", "seq", "a", "b", F.col("score").cast("double").alias("score"))
    dealt = rows.repartition("session").sortWithinPartitions("session", "seq", "a", "b").select("session", "a", "b", "score")
    return dealt.mapInArrow(_fold_batches, "session long, item long, rating long, comparisons long, wins long, losses long")


def next_pairs(ratings: DataFrame, compared: DataFrame, k: int = 1) -> DataFrame:
    """``session, a, b``: for each session the ``k`` best pairs that have not met: of neighbours by rating the least compared first, then of items further apart.

    Items are numbered by rating. Pairs 1 to 3 places apart come first; sessions that lack pairs then go on with 4 to 7 places, 8 to 15 and so on up
    to their size, so an unmet pair is found wherever there is one, and no session's pairs are all made while nearer ones do. ``ratings``: ``session, item, rating, comparisons``;
    ``compared``: ``session, a, b``.
    """
    place = F.row_number().over(W.partitionBy("session").orderBy(F.desc("rating"), "item"))
    items = materialise(ratings.select("session", "item", "comparisons", place.alias("place")), "pairs-items")
    met = materialise(compared.select("session", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs-met")
    lacking = items.groupBy("session").agg(F.max("place").alias("size")).where("size > 1").withColumn("need", F.lit(k))
    lacking, found, low, high = materialise(lacking, "pairs-lacking"), None, 1, 3
    while not lacking.isEmpty():
        x = items.join(lacking, "session").withColumn("step", F.explode(F.sequence(F.lit(low), F.lit(high)))).where(F.col("place") + F.col("step") <= F.col("size"))
        x = x.select("session", F.col("item").alias("x"), F.col("comparisons").alias("nx"), (F.col("place") + F.col("step")).alias("place"), "step", "need")
        y = items.select("session", F.col("item").alias("y"), F.col("comparisons").alias("ny"), "place")
        pairs = x.join(y, ["session", "place"]).select("session", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), (F.col("nx") + F.col("ny")).alias("n"), "step", "need")
        fresh = pairs.join(met, ["session", "a", "b"], "left_anti")
        best = F.row_number().over(W.partitionBy("session").orderBy("n", "step", "a", "b"))
        taken = materialise(fresh.withColumn("p", best).where(F.col("p") <= F.col("need")).select("session", "a", "b"), "pairs-taken")
        found = taken if found is None else found.unionByName(taken)
        got = taken.groupBy("session").agg(F.count("*").alias("got"))
        left = lacking.join(got, "session", "left").withColumn("need", F.col("need") - F.coalesce("got", F.lit(0))).where((F.col("need") > 0) & (F.col("size") > high + 1))
        lacking, low, high = materialise(left.drop("got"), "pairs-lacking"), high + 1, 2 * high + 1
    return items.select("session", F.col("item").alias("a"), F.col("item").alias("b")).limit(0) if found is None else found
