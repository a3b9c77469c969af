"""Best-fit packing of token sequences into bins of several permitted lengths.

Sequences longer than the largest length are split; their full pieces fill bins of
their own, so only remainders are packed. Remainders are dealt at random, in even
shares, to groups of bounded size, and each group is packed by best fit decreasing: a piece goes to the
open bin that it leaves the least room in. When none has room, the bin size of least
cost for each token that it can still receive is opened. The sizes that may be opened are
chosen jointly: the packing is tried with every ceiling, each bin is downsized
to the smallest length that holds its contents, and the cheapest outcome stays.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gleaner.llm.textvec import IS_SPACE, spans, text_chunks
from gleaner.session import materialise

LENGTHS = (256, 512, 1024, 2048, 4096)
GROUP_ROWS = 4_000  # remainders that are packed together, about: what the last bins of a group leave empty is under 0.1 % of it


def cost(length: int, longest: int) -> float:
    """Cost of a bin: its tokens, an attention term that grows with the square of the length, and a fixed part."""
    return length * (1 + 0.25 * length / longest) + 16


def _pack(sizes: np.ndarray, lengths: Sequence[int], ceiling: int, costs: dict[int, float]) -> tuple[np.ndarray, list[int], float]:
    """Best fit of sizes (in decreasing order), opening no more than ``ceiling`` unless a piece needs it: bins, their final lengths, cost."""
    rest = int(sizes.sum())
    holds: list[list[int]] = [[] for _ in range(lengths[-1] + 1)]  # open bins by room
    rooms = 0  # bit r: some bin has room r
    bins, used = np.empty(len(sizes), np.int64), []
    free = [c for c in lengths if c <= ceiling]
    for i, size in enumerate(sizes.tolist()):
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            at = holds[room].pop()
            if not holds[room]:
                rooms ^= 1 << room
        else:
            able = [c for c in free if c >= size] or [next(c for c in lengths if c >= size)]
            room = min(able, key=lambda c: costs[c] / min(c, rest))
            at = len(used)
            used.append(0)
        bins[i] = at
        used[at] += size
        rest -= size
        room -= size
        if room:
            holds[room].append(at)
            rooms |= 1 << room
    final = np.asarray(lengths)[np.searchsorted(lengths, used)].tolist()
    return bins, final, sum(costs[c] for c in final)


def least_cost(sizes: np.ndarray, lengths: Sequence[int] = LENGTHS) -> float:
    """A bound that no packing is below: every token at the lowest cost for each token of the bins that can hold its piece."""
    lengths = sorted(set(lengths))
    each = np.array([cost(c, lengths[-1]) / c for c in lengths])
    best = np.minimum.accumulate(each[::-1])[::-1]
    return float((sizes * best[np.searchsorted(lengths, sizes)]).sum())


def pack_sizes(sizes: np.ndarray, lengths: Sequence[int] = LENGTHS) -> tuple[np.ndarray, np.ndarray]:
    """Bin number of each size and the final length of each bin; sizes are 1 to the largest length."""
    lengths = sorted(set(lengths))
    costs = {c: cost(c, lengths[-1]) for c in lengths}
    order = np.argsort(-sizes, kind="stable")
    bins, final, _ = min((_pack(sizes[order], lengths, c, costs) for c in lengths), key=lambda x: x[2])
    out = np.empty(len(sizes), np.int64)
    out[order] = bins
    return out, np.asarray(final, np.int64)


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, buf, offsets in text_chunks(batch.column(1)):
            row = spans(~IS_SPACE[buf], offsets)[2]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.bincount(row, minlength=b - a) + 1)], ["doc_id", "n_tokens"])


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens``: the words of each whole text and one end; null and empty texts have their end only."""
    src = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"))
    return src.mapInArrow(_count_batches, "doc_id long, n_tokens long")


def pack(counted: DataFrame, id_col: str = "doc_id", count_col: str = "n_tokens", lengths: Sequence[int] = LENGTHS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``doc_id, piece, first_token, n_tokens, bin_id, bin_length, bin_offset``: every token of every row in one bin.

    Rows with a null or non-positive count have nothing to pack and give no row. Null ids and repeated rows are
    packed like others. Bin ids are strings: ``f`` bins hold one full piece, ``g`` bins are of a group. An empty table gives an empty result.
    """
    lengths = sorted({int(c) for c in lengths})
    longest = lengths[-1]
    src = counted.select(counted[id_col].cast("long").alias("doc_id"), counted[count_col].cast("long").alias("n")).where("n > 0")
    rows = materialise(src.withColumn("r", F.rand(11)), "packing-counts")
    size = rows.agg(F.count_if(F.col("n") % longest != 0).alias("n")).first()["n"]
    groups = max(1, -(-size // group_rows))
    # the seeded number is written with the row, so a repeated task deals alike
    full = (
        rows.where(F.col("n") >= longest)
        .select("doc_id", "r", F.explode(F.sequence(F.lit(0), F.expr(f"n div {longest}") - 1)).alias("piece"))
        .select(
            "doc_id",
            F.col("piece").cast("long").alias("piece"),
            (F.col("piece") * longest).alias("first_token"),
            F.lit(longest).cast("long").alias("n_tokens"),
            F.format_string("f-%016x-%d", F.xxhash64("doc_id", "r"), F.col("piece")).alias("bin_id"),
            F.lit(longest).cast("long").alias("bin_length"),
            F.lit(0).cast("long").alias("bin_offset"),
        )
    )
    rest = rows.where(F.col("n") % longest != 0).select("doc_id", "n", "r", F.floor(F.col("r") * groups).cast("int").alias("g"))

    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("r", kind="stable").reset_index(drop=True)
        sizes = (part["n"] % longest).to_numpy(np.int64)
        bins, final = pack_sizes(sizes, lengths)
        order = np.lexsort((np.arange(len(bins)), bins))
        run = np.cumsum(sizes[order]) - sizes[order]
        first = np.concatenate([[True], bins[order][1:] != bins[order][:-1]])
        offset = np.empty(len(bins), np.int64)
        offset[order] = run - np.maximum.accumulate(np.where(first, run, 0))
        whole = part["n"] // longest
        g = int(part["g"].iloc[0])
        return pd.DataFrame(
            {
                "doc_id": part["doc_id"].astype("Int64"),
                "piece": whole,
                "first_token": whole * longest,
                "n_tokens": sizes,
                "bin_id": [f"g-{g}-{b}" for b in bins],
                "bin_length": final[bins],
                "bin_offset": offset,
            }
        )

    packed = rest.groupBy("g").applyInPandas(one, "doc_id long, piece long, first_token long, n_tokens long, bin_id string, bin_length long, bin_offset long")
    return full.unionByName(packed)


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``pack`` over the words of whole texts."""
    return pack(token_counts(df, id_col, text_col))
