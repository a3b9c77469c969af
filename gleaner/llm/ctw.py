"""Language-model scoring by context-tree weighting over bytes.

A text is its lower-cased words joined by one space and closed by an end symbol. Every
byte is eight binary decisions; a decision's contexts are the last 0 to 5 bytes. Each node of
a context tree holds a Krichevsky-Trofimov estimate of its bit, and the estimates
of all depths are mixed with the weights of context-tree weighting, which follow from
the block probabilities of the training texts.

Spark counts the 6-byte grams of all texts (training occurrences; grams of other texts with
count 0) and deals them to buckets of bounded size. A bucket holds whole subtrees of contexts of 2 bytes; a context with
too many grams is split by its third latest byte and then by its fourth, below which there are 65 536 grams at most. Each bucket
sums up the nodes above its subtrees, these are joined level by level, and a second pass over the buckets, with the nodes above each beside it, gives
each gram's probability; depths 0 and 1 are joined on the driver from at most 65 280 rows. Scoring sums gram probabilities: the most frequent grams and words come
from broadcast tables of fixed size, all others are joined exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from gleaner.llm.textvec import CHUNK_BYTES, IS_SPACE, LOWER, crc32_text, prefix_hash, span_hash, spans, stretches, text_chunks
from gleaner.session import materialise

DEPTH = 5
SPLITS = (2, 3, 4)  # depths of the contexts whose subtrees a bucket holds whole
END = 0xFF  # never part of UTF-8
FREQUENT_GRAMS = 1 << 20  # rows of the broadcast tables, at most
FREQUENT_WORDS = 1 << 18
BUCKET_ROWS = 50_000  # grams of a bucket, at most (65 536 if that is more)
WORD = np.uint64(1 << 63)  # set in the keys of words, never in those of grams


Symbols = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def symbols(buf: np.ndarray, offsets: np.ndarray) -> Iterator[Symbols]:
    """Gram keys and their rows, word keys and their rows of a chunk of texts (an end closes each row); of a long text alone a stretch at a time."""
    if len(offsets) > 2 or len(buf) <= CHUNK_BYTES:
        yield _symbols(buf, offsets, None, True)[0]
        return
    size = len(buf)
    while size and IS_SPACE[buf[size - 1]]:  # white space at the end is no gap between words
        step = IS_SPACE[buf[max(0, size - 65536) : size]]
        size -= len(step) if step.all() else int(np.argmin(step[::-1]))
    before = None
    for a, b in stretches(buf[:size], IS_SPACE) if size else [(0, 0)]:
        if b < size and IS_SPACE[buf[a:b]].all():
            continue
        found, before = _symbols(buf[a:b], np.array([0, b - a]), before, b == size)
        yield found


def _symbols(buf: np.ndarray, offsets: np.ndarray, before: np.ndarray | None, last: bool) -> tuple[Symbols, np.ndarray]:
    """The symbols of whole texts, or of a stretch of one text: ``before`` holds the bytes before it, and a space closes it unless it is the ``last``."""
    n = len(offsets) - 1
    low = LOWER[buf]
    starts, ends, row = spans(~IS_SPACE[buf], offsets)
    lengths = ends - starts
    word_bytes = np.concatenate([[0], np.cumsum(lengths)])
    words = np.bincount(row, minlength=n)
    size = DEPTH + np.maximum(np.bincount(row, weights=lengths + 1, minlength=n).astype(np.int64), 1)
    row_end = np.cumsum(size)
    first_word = np.cumsum(words) - words
    at = np.cumsum(lengths + 1) - (lengths + 1)
    if len(starts):
        at = at - at[np.minimum(first_word, len(at) - 1)][row] + (row_end - size)[row] + DEPTH
    out = np.full(int(row_end[-1]), 32, np.uint8)
    out[np.arange(word_bytes[-1]) + np.repeat(at - word_bytes[:-1], lengths)] = low[~IS_SPACE[buf]]
    real = np.ones(len(out), bool)
    for j in range(DEPTH):
        out[row_end - size + j] = 0 if before is None else before[j]
        real[row_end - size + j] = False
    out[row_end - 1] = END if last else 32
    wide = out.astype(np.uint64)
    key = wide.copy()
    for d in range(1, DEPTH + 1):
        key[d:] |= wide[:-d] << np.uint64(8 * d)
    tokens = np.full(len(starts) + n, WORD)
    token_at = np.arange(len(starts)) + row
    tokens[token_at] = span_hash(prefix_hash(low), starts, ends) | WORD
    token_rows = np.repeat(np.arange(n), words + 1)
    return (key[real], np.repeat(np.arange(n), size - DEPTH), tokens if last else tokens[:-1], token_rows if last else token_rows[:-1]), out[-DEPTH:]


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    codes, unique = pd.factorize(keys)
    return unique, np.bincount(codes, weights=counts, minlength=len(unique)).astype(np.int64)


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts, held = [], 0
    for batch in batches:
        train = batch.column(0).to_numpy(zero_copy_only=False).astype(bool)
        for a, b, buf, offsets in text_chunks(batch.column(1)):
            for keys, rows, tokens, token_rows in symbols(buf, offsets):
                for k, r in ((keys, rows), (tokens, token_rows)):
                    codes, unique = pd.factorize(k)
                    parts.append((unique, np.bincount(codes, weights=train[a:b][r], minlength=len(unique))))
                    held += len(unique)
                if held > 3_000_000:
                    parts = [_merge(parts)]
                    held = len(parts[0][0])
                    if held > 1_500_000:
                        yield from _counted(parts.pop())
                        held = 0
    if parts:
        yield from _counted(_merge(parts))


def _counted(found: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
    order = np.argsort(found[0])
    keys, counts = found[0][order].view(np.int64), found[1][order].astype(np.int64)
    for i in range(0, len(keys), 200_000):
        yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 200_000]), pa.array(counts[i : i + 200_000])], ["key", "n"])


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """For x >= 0.5: Stirling's series after a shift by seven."""
    shift = np.ones_like(x)
    for i in range(7):
        shift = shift * np.where(x < 64, x + i, 1)
    y = np.where(x < 64, x + 7, x)
    r = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - r * (1 / 360 - r / 1260)) / y - np.log(shift)


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log block probability of a zeros and b ones under the Krichevsky-Trofimov estimator."""
    return _log_gamma(a + 0.5) + _log_gamma(b + 0.5) - _log_gamma(a + b + 1.0) - np.log(np.pi)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -700, 700)))


def tree(keys: np.ndarray, n: np.ndarray, top: int) -> tuple[list[tuple], np.ndarray, np.ndarray]:
    """Nodes of depth ``top`` and, for each gram and bit, the mixed probability of that bit from ``top`` on downwards.

    ``keys`` are distinct grams that hold every gram of their ``top`` latest context bytes. Returns for each bit
    (context and prefix, zeros, ones, log weighted probability), then probabilities (8, grams) and bits (8, grams).
    """
    keys = keys.astype(np.int64)
    order = np.argsort(keys)
    here, count, to_here = keys[order], n[order].astype(np.float64), np.empty(len(keys), np.int64)
    to_here[order] = np.arange(len(keys))
    bits = (keys[None, :] >> (7 - np.arange(8))[:, None]) & 1
    mixed, below, inverse = np.zeros((8, len(keys))), [None] * 8, None
    levels = []
    for d in range(DEPTH, top - 1, -1):
        if d < DEPTH:
            up, inverse = np.unique(here & ((1 << 8 * (d + 1)) - 1), return_inverse=True)
            count = np.bincount(inverse, weights=count, minlength=len(up))
            here, to_here = up, inverse[to_here]
        level = []
        for k in range(8):
            node = here >> (8 - k)
            first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
            of = np.zeros(len(here), np.int64)
            of[first[1:]] = 1
            of = np.cumsum(of)
            ones = np.add.reduceat(count * (here >> (7 - k) & 1), first)
            zeros = np.add.reduceat(count, first) - ones
            own = log_kt(zeros, ones)
            if d == DEPTH:
                weight, total = np.ones(len(first)), own
            else:
                children = np.bincount(of[inverse[below[k][0]]], weights=below[k][1], minlength=len(first))
                weight, total = _sigmoid(own - children), np.logaddexp(own, children) - np.log(2)
            below[k] = (first, total)
            level.append((weight, zeros, ones, of, node[first], total))
        levels.append((level, to_here))
    for level, place in levels:
        for k in range(8):
            weight, zeros, ones, of, _, _ = level[k]
            at = of[place]
            hit = np.where(bits[k] == 1, ones[at], zeros[at])
            own = (hit + 0.5) / (zeros[at] + ones[at] + 1)
            mixed[k] = weight[at] * own + (1 - weight[at]) * mixed[k]
    tops = [(node, zeros, ones, total) for _, zeros, ones, _, node, total in levels[-1][0]]
    return tops, mixed, bits


NODES = "depth int, node long, zeros double, ones double, below double"  # node: context of that depth, then a bit prefix led by a 1, in 8 bits


def _top_nodes(part: pd.DataFrame) -> pd.DataFrame:
    """What a bucket adds to the nodes above its subtrees: counts, and the log probabilities of the nodes below summed."""
    out, top = [], int(part["part"].iloc[0]) >> 56
    for k, (node, zeros, ones, total) in enumerate(tree(part["key"].to_numpy(), part["n"].to_numpy(), top)[0]):
        above = (node >> k) & (1 << 8 * (top - 1)) - 1
        out.append(pd.DataFrame({"depth": top - 1, "node": above << 8 | 1 << k | node & ((1 << k) - 1), "zeros": zeros, "ones": ones, "below": total}))
    return pd.concat(out).groupby(["depth", "node"], as_index=False).sum()


def _weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for x in batches:
        own = log_kt(x["zeros"].to_numpy(), x["ones"].to_numpy())
        yield x.assign(weight=_sigmoid(own - x["below"]), total=np.logaddexp(own, x["below"]) - np.log(2))


def _upper_nodes(sums: DataFrame) -> tuple[DataFrame, list]:
    """The written nodes of depth 2 and 3 of contexts that were split, with their weights, and the rows of depth 1 (65 280 at most)."""
    weighed = []
    for depth in (3, 2):
        own = sums.where(F.col("depth") == depth).groupBy("depth", "node").agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "below")))
        own = materialise(own.mapInPandas(_weigh, f"{NODES}, weight double, total double"), "ctw-upper")
        weighed.append(own)
        shorter = F.shiftright("node", 8).bitwiseAND(F.lit((1 << 8 * (depth - 1)) - 1))
        above = F.shiftleft(shorter, 8).bitwiseOR(F.col("node").bitwiseAND(F.lit(255)))
        sums = sums.unionByName(own.select((F.col("depth") - 1).alias("depth"), above.alias("node"), "zeros", "ones", F.col("total").alias("below")))
    rows = sums.where("depth = 1").groupBy("node").agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "below"))).collect()
    return weighed[0].unionByName(weighed[1]), rows


def _top_tables(rows: list) -> tuple[np.ndarray, ...]:
    """For depths 1 and 0: weights, zeros and ones by (latest byte, prefix) and by prefix."""
    zeros, ones, children = (np.zeros((256, 256)) for _ in range(3))
    for r in rows:
        zeros[r.node >> 8, r.node & 255], ones[r.node >> 8, r.node & 255], children[r.node >> 8, r.node & 255] = r.zeros, r.ones, r.below
    own = log_kt(zeros, ones)
    w1, below = _sigmoid(own - children), (np.logaddexp(own, children) - np.log(2)).sum(0)
    z0, o0 = zeros.sum(0), ones.sum(0)
    return w1, zeros, ones, _sigmoid(log_kt(z0, o0) - below), z0, o0


def _scorer(tops: tuple[np.ndarray, ...]):
    w1, z1, o1, w0, z0, o0 = tops

    def run(part: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        if not len(part):
            return pd.DataFrame({"key": np.zeros(0, np.int64), "n": np.zeros(0, np.int64), "log10p": np.zeros(0)})
        top = int(part["part"].iloc[0]) >> 56
        keys = part["key"].to_numpy()
        _, mixed, bits = tree(keys, part["n"].to_numpy(), top)
        mids = {}
        for depth in range(top - 1, 1, -1):  # a bucket of split contexts is of one context at each depth above
            own = above[above["depth"] == depth]
            mids[depth] = tuple(np.zeros(256) for _ in range(3))
            for table, c in zip(mids[depth], ("weight", "zeros", "ones"), strict=True):
                table[own["node"].to_numpy() & 255] = own[c]
        total, c1 = np.zeros(len(keys)), keys >> 8 & 255
        for k in range(8):
            j = 1 << k | (keys & 255) >> (8 - k)
            p, one = mixed[k], bits[k] == 1
            for w, z, o in (*(tuple(t[j] for t in mids[d]) for d in mids), (w1[c1, j], z1[c1, j], o1[c1, j]), (w0[j], z0[j], o0[j])):
                p = w * (np.where(one, o, z) + 0.5) / (z + o + 1) + (1 - w) * p
            total += np.log10(p)
        return pd.DataFrame({"key": keys, "n": part["n"], "log10p": total})

    return run


def buckets(grams: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Add ``part`` to written rows with ``key``: the depth of the whole subtrees in it, the context above, and a number, in one long.

    Contexts of one parent are dealt side by side to buckets of up to ``bucket_rows``; one that holds more than half of that is split by its next byte.
    """
    context = lambda depth: F.shiftright("key", 8).bitwiseAND(F.lit((1 << 8 * depth) - 1))
    unit = max(1, bucket_rows // 2)
    sizes = materialise(grams.groupBy(context(SPLITS[-1]).alias("key4")).agg(F.count("*").alias("n")), "ctw-contexts").withColumnRenamed("key4", "c")
    part, split = F.lit(None).cast("long"), None
    for depth in SPLITS:
        above = (1 << 8 * (depth - 1)) - 1
        own = sizes.withColumn("c", F.col("c").bitwiseAND(F.lit((1 << 8 * depth) - 1))).groupBy("c").agg(F.sum("n").alias("n"))
        own = own.withColumn("up", F.col("c").bitwiseAND(F.lit(above)))
        if split is not None:
            own = own.join(split.select(F.col("c").alias("up")), "up", "left_semi")
        own = materialise(own, "ctw-contexts")
        whole = own if depth == SPLITS[-1] else own.where(F.col("n") <= unit)
        before = F.sum("n").over(W.partitionBy("up").orderBy("c").rowsBetween(W.unboundedPreceding, -1))  # 256 contexts of one parent at most
        number = F.floor(F.coalesce(before, F.lit(0)) / unit)
        dealt = whole.select(F.col("c").alias(f"c{depth}"), F.lit(depth << 56).bitwiseOR(F.shiftleft("up", 24)).bitwiseOR(number.cast("long")).alias(f"p{depth}"))
        grams = grams.withColumn(f"c{depth}", context(depth)).join(materialise(dealt, "ctw-dealt"), f"c{depth}", "left")
        part = F.coalesce(part, f"p{depth}")
        split = own.where(F.col("n") > unit)
    return grams.withColumn("part", part).drop(*(f"{c}{depth}" for depth in SPLITS for c in "cp"))


def fit(df: DataFrame, train: str, text: str, bucket_rows: int = BUCKET_ROWS) -> tuple[DataFrame, dict]:
    """The written table ``key, n, log10p`` of all grams and words of ``df``, and the counts N and V of its training tokens.

    ``train`` and ``text`` name columns: whether a row is learnt from, and its text.
    """
    counted = df.select(F.coalesce(df[train], F.lit(False)).alias("train"), df[text].cast("string").alias("text"))
    counts = materialise(counted.mapInArrow(_count_batches, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "ctw-counts")
    totals = counts.agg(
        F.coalesce(F.sum(F.when(F.col("key") < 0, F.col("n"))), F.lit(0)).alias("N"),
        F.count_if((F.col("key") < 0) & (F.col("n") > 0)).alias("V"),
    ).first()
    grams = buckets(counts.where("key >= 0"), bucket_rows)
    sums = materialise(grams.groupBy("part").applyInPandas(_top_nodes, NODES), "ctw-nodes")
    upper, rows = _upper_nodes(sums)
    # each bucket of split contexts gets the nodes of the contexts above it
    up = F.shiftright("part", 24).bitwiseAND(F.lit((1 << 32) - 1))
    asked = grams.select("part").where(F.shiftright("part", 56) > 2).distinct()
    depth = F.explode(F.when(F.shiftright("part", 56) == 3, F.array(F.lit(2))).otherwise(F.array(F.lit(2), F.lit(3)))).alias("depth")
    asked = asked.select("part", up.alias("up"), depth).withColumn("c", F.col("up").bitwiseAND(F.when(F.col("depth") == 2, F.lit(0xFFFF)).otherwise(F.lit(0xFFFFFF))))
    nodes = upper.withColumn("c", F.shiftright("node", 8))
    above = materialise(asked.join(nodes, ["depth", "c"]).select("part", "depth", "node", "weight", "zeros", "ones"), "ctw-above")
    scored = grams.groupBy("part").cogroup(above.groupBy("part")).applyInPandas(_scorer(_top_tables(rows)), "key long, n long, log10p double")
    words = counts.where("key < 0").select("key", "n", F.log10((F.col("n") + 0.1) / (F.lit(totals["N"] + 0.1 * (totals["V"] + 1)))).alias("log10p"))
    return materialise(scored.unionByName(words), "ctw-model"), {"N": totals["N"], "V": totals["V"]}


def _frequent(model: DataFrame, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows of the highest counts, at most ``limit``, by key; a step of a count is in whole or not at all."""
    step = F.floor(F.log2(F.col("n")) * 8).cast("int")
    seen, least = 0, None
    for r in sorted(model.where("n > 0").groupBy(step.alias("s")).count().collect(), key=lambda r: -r["s"]):
        seen += r["count"]
        if seen > limit:
            break
        least = r["s"]
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    t = model.where("n > 0").where(step >= least).select("key", "n", "log10p").toArrow().sort_by("key")
    return tuple(t.column(i).to_numpy() for i in range(3))


def _look_up(keys: np.ndarray, rows: np.ndarray, n: int, held: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """Per row the sum over known keys and how many have a count; then (row, key, times) of the others."""
    codes, unique = pd.factorize(keys.view(np.int64))
    at = np.minimum(np.searchsorted(held[0], unique), max(len(held[0]) - 1, 0))
    known = held[0][at] == unique if len(held[0]) else np.zeros(len(unique), bool)
    value = np.where(known, held[2][at], 0.0) if len(held[0]) else np.zeros(len(unique))
    sums = np.add.reduceat(value[codes], np.searchsorted(rows, np.arange(n)))
    hits = np.bincount(rows[known[codes]], minlength=n)
    rest = np.flatnonzero(~known[codes])
    pair, times = np.unique(rows[rest] * len(unique) + codes[rest], return_counts=True)
    return sums, hits, pair // len(unique), unique[pair % len(unique)], times


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every row of ``df``; rows whose crc32(id as text) mod 10 is not 0 are learnt from.

    Returns ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score,
    bits_per_byte`` (code length over the bytes of the normalised text, its end included). A null text is an
    empty one: its only token is the end. Null ids count as the empty string. Equal texts score
    alike; repeated rows stay repeated. With nothing to learn from, all counts are 0 and all estimates even.
    """
    src = df.select(df[id_col].cast("long").alias("doc_id"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"))
    src = src.withColumn("held_out", F.expr(f"{crc32_text('doc_id')} % 10 = 0"))
    model, total = fit(src.withColumn("train", ~F.col("held_out")), "train", "text")
    spark = df.sparkSession
    grams = spark.sparkContext.broadcast(_frequent(model.where("key >= 0"), FREQUENT_GRAMS))
    words = spark.sparkContext.broadcast(_frequent(model.where("key < 0"), FREQUENT_WORDS))

    def score_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, offsets in text_chunks(batch.column(4)):
                n = b - a
                total_p, base, known, n_tokens, n_bytes = np.zeros(n), np.zeros(n), *(np.zeros(n, np.int64) for _ in range(3))
                found = []
                for keys, rows, tokens, token_rows in symbols(buf, offsets):
                    p, _, *rare = _look_up(keys, rows, n, grams.value)
                    found.append(rare)
                    total_p += p
                    if len(tokens):
                        p, hits, *rare = _look_up(tokens, token_rows, n, words.value)
                        found.append(rare)
                        base, known = base + p, known + hits
                    n_tokens += np.bincount(token_rows, minlength=n)
                    n_bytes += np.bincount(rows, minlength=n)
                r, k, t = (np.concatenate(x) for x in zip(*found, strict=True))
                if n == 1:  # stretches of one text
                    codes, k = pd.factorize(k)
                    r, t = np.zeros(len(k), np.int64), np.bincount(codes, weights=t, minlength=len(k)).astype(np.int64)
                order = np.argsort(r, kind="stable")
                edges = pa.array(np.searchsorted(r[order], np.arange(n + 1)).astype(np.int32))
                rare = [pa.ListArray.from_arrays(edges, pa.array(x[order])) for x in (k, t.astype(np.int32))]
                fixed = [batch.column(i).slice(a, n) for i in range(4)]
                own = [pa.array(n_tokens), pa.array(n_bytes), pa.array(known), pa.array(base), pa.array(total_p)]
                yield pa.RecordBatch.from_arrays(
                    [*fixed, *own, *rare], ["doc_id", "held_out", "t1", "t2", "n_tokens", "n_bytes", "known", "base", "p", "keys", "times"]
                )

    named = src.select("doc_id", "held_out", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"), "text")
    first = materialise(
        named.mapInArrow(
            score_batches,
            "doc_id long, held_out boolean, t1 long, t2 long, n_tokens long, n_bytes long, known long, base double, p double, "
            "keys array<long>, times array<int>",
        ),
        "ctw-first",
    )
    rare = (
        first.select("t1", "t2", F.explode(F.arrays_zip("keys", "times")).alias("r"))
        .groupBy("t1", "t2", F.col("r.keys").alias("key"))
        .agg(F.max("r.times").alias("times"))
        .join(model, "key")
        .groupBy("t1", "t2")
        .agg(
            F.sum(F.when(F.col("key") >= 0, F.col("times") * F.col("log10p")).otherwise(0.0)).alias("p1"),
            F.sum(F.when(F.col("key") < 0, F.col("times") * F.col("log10p")).otherwise(0.0)).alias("base1"),
            F.sum(F.when((F.col("key") < 0) & (F.col("n") > 0), F.col("times")).otherwise(0)).alias("known1"),
        )
    )
    p = F.col("p") + F.coalesce("p1", F.lit(0.0))
    return first.join(rare, ["t1", "t2"], "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("known1", F.lit(0))).alias("n_known"),
        F.lit(total["N"]).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base1", F.lit(0.0))).alias("base_score"),
        p.alias("score"),
        (-p / F.log10(F.lit(2.0)) / F.col("n_bytes")).alias("bits_per_byte"),
    )
