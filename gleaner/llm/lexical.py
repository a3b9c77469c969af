"""Ranked lexical search of a set of items over all documents, by sort-based accumulation.

Items are taken in blocks whose terms fit a broadcast by rule (``BLOCK_ITEMS``, ``BLOCK_BYTES``); for each block the documents are read twice. The
first pass counts documents, terms and the documents that hold each of the block's terms. The second scores: a task concatenates, for a range of its documents,
arrays of matched item, document and impact, sorts the packed keys by radix, sums impacts between borders and keeps each item's best in a heap. A
document is scored where it is read, so only each task's best rows are shuffled; these meet by item.

Terms are the runs of ASCII letters, digits and all characters beyond ASCII, A-Z lower-cased, of the whole text. Null texts and such without
terms match nothing and do not count. Rows of documents that are equal are documents of their own; a null ``doc_id`` comes last among equal scores. Rows of items
that are equal are one item; items of the same id and other text are ranked each by itself. No items or no documents: no rows. Other columns are
not read.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from gleaner.llm.textvec import CHUNK_BYTES, LOWER, prefix_hash, span_hash, spans, text_chunks

TOP = 10
BLOCK_ITEMS = 1024
BLOCK_BYTES = 4 << 20
RANGE_PAIRS = 1 << 20  # matched pairs of item and document that one range of documents has, unless one document has more

_TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
IS_TERM = np.zeros(256, bool)
IS_TERM[48:58] = IS_TERM[65:91] = IS_TERM[97:123] = IS_TERM[128:] = True


class Block(NamedTuple):
    """Items with their terms: term t has its items and their repeats at ``start[t]`` to ``start[t + 1]``."""

    ids: list[int | None]
    hashes: np.ndarray  # sorted
    sizes: np.ndarray
    ends: np.ndarray  # first and last byte
    longest: int
    start: np.ndarray
    items: np.ndarray
    repeats: np.ndarray


def block_of(rows: list[tuple[int | None, str]]) -> Block:
    """A block of the items ``(id, text)``."""
    held: dict[bytes, list[tuple[int, int]]] = {}
    for i, (_, text) in enumerate(rows):
        for term, n in Counter(t.lower() for t in _TERM.findall(text.encode())).items():
            held.setdefault(term, []).append((i, n))
    terms = list(held)
    at = np.concatenate([[0], np.cumsum([len(t) for t in terms], dtype=np.int64)]).astype(np.int64)
    hashes = span_hash(prefix_hash(np.array(bytearray(b"".join(terms)), np.uint8)), at[:-1], at[1:])
    order = np.argsort(hashes)
    terms = [terms[i] for i in order]
    lists = [held[t] for t in terms]
    start = np.concatenate([[0], np.cumsum([len(x) for x in lists], dtype=np.int64)]).astype(np.int64)
    flat = np.array([pair for x in lists for pair in x], np.int64).reshape(-1, 2)
    ends = np.array([t[0] << 8 | t[-1] for t in terms], np.int64)
    return Block([i for i, _ in rows], hashes[order], np.array([len(t) for t in terms], np.int64), ends, max(map(len, terms), default=0), start, flat[:, 0], flat[:, 1])


def postings(buf: np.ndarray, offsets: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and count of the block's terms in rows of text, by row and term; and how many terms each row has.

    Windows of ``CHUNK_BYTES`` overlap by the longest term, so a text of any length is read whole in bounded memory.
    """
    n_rows, n_terms = len(offsets) - 1, len(block.hashes)
    lengths = np.zeros(n_rows, np.int64)
    keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a in range(0, len(buf), CHUNK_BYTES):
        b = min(a + CHUNK_BYTES, len(buf))
        low, high = max(a - 1, 0), min(b + block.longest + 1, len(buf))
        part = LOWER[buf[low:high]]
        starts, ends, rows = spans(IS_TERM[part], np.clip(offsets - low, 0, high - low))
        own = (starts + low >= a) & (starts + low < b)
        lengths += np.bincount(rows[own], minlength=n_rows)
        own &= ends - starts <= block.longest
        starts, ends, rows = starts[own], ends[own], rows[own]
        if not len(starts) or not n_terms:
            continue
        h = span_hash(prefix_hash(part), starts, ends)
        term = np.minimum(np.searchsorted(block.hashes, h), n_terms - 1)
        hit = (block.hashes[term] == h) & (block.sizes[term] == ends - starts) & (block.ends[term] == (part[starts].astype(np.int64) << 8 | part[ends - 1]))
        k, n = np.unique(rows[hit] * n_terms + term[hit], return_counts=True)
        keys.append(k)
        counts.append(n)
    key, count = np.concatenate(keys), np.concatenate(counts)
    if len(keys) > 2 and len(key):
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        key, count = key[first], np.add.reduceat(count[order], first)
    return key // max(n_terms, 1), key % max(n_terms, 1), count, lengths


def radix_order(key: np.ndarray) -> np.ndarray:
    """The stable order of unsigned keys, by digits of 16 bits from the last."""
    order = np.argsort((key & 0xFFFF).astype(np.uint16), kind="stable")
    top = int(key.max()) if len(key) else 0
    for shift in range(16, top.bit_length(), 16):
        order = order[np.argsort((key[order] >> shift & 0xFFFF).astype(np.uint16), kind="stable")]
    return order


def accumulate(row: np.ndarray, term: np.ndarray, impact: np.ndarray, block: Block) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Item, row and summed score of every pair that shares a term, for one range of rows after another. Postings come by row."""
    times = block.start[term + 1] - block.start[term]
    upto = np.cumsum(times)
    at = 0
    while at < len(row):
        to = int(np.searchsorted(upto, (upto[at - 1] if at else 0) + RANGE_PAIRS, "right"))
        last = row[min(max(to, at + 1), len(row)) - 1]
        if to < len(row):  # whole rows only
            cut = int(np.searchsorted(row, last, "left"))
            to = cut if cut > at else int(np.searchsorted(row, last, "right"))
        reps = times[at:to]
        begin = np.repeat(block.start[term[at:to]] - (np.cumsum(reps) - reps), reps)
        slot = begin + np.arange(len(begin))
        base, wide = int(row[at]), int(row[to - 1] - row[at]) + 1
        key = block.items[slot] * wide + np.repeat(row[at:to] - base, reps)
        value = np.repeat(impact[at:to], reps) * block.repeats[slot]
        order = radix_order(key)
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        yield key[first] // wide, key[first] % wide + base, np.add.reduceat(value[order], first)
        at = to


def _stats_batches(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = held.value
        df, docs, total = np.zeros(len(block.hashes), np.int64), 0, 0
        for batch in batches:
            for _, _, buf, offsets in text_chunks(batch.column(0)):
                _, term, _, lengths = postings(buf, offsets, block)
                df += np.bincount(term, minlength=len(df))
                docs, total = docs + int((lengths > 0).sum()), total + int(lengths.sum())
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-2, -1], at])), pa.array(np.concatenate([[docs, total], df[at]]))], ["term", "n"])

    return run


def _score_batches(held, weights: np.ndarray, n_docs: int, n_terms: int, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = held.value
        heaps: list[list[tuple[int, bool, int]]] = [[] for _ in block.ids]
        least = np.zeros(len(block.ids), np.int64)  # an item's last score once it has enough
        for batch in batches:
            ids = batch.column(0)
            known, ids = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            for first, to, buf, offsets in text_chunks(batch.column(1)):
                row, term, tf, lengths = postings(buf, offsets, block)
                m = np.array([25 + 75 * int(n) * n_docs // n_terms for n in lengths], np.int64)
                impact = weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[row]))
                own_ids, own_known = ids[first:to], known[first:to]
                for item, r, score in accumulate(row, term, impact, block):
                    keep = np.flatnonzero((score > 0) & (score >= least[item]))
                    item, r, score = item[keep], r[keep], score[keep]
                    order = np.lexsort((own_ids[r], ~own_known[r], -score, item))
                    item, r, score = item[order], r[order], score[order]
                    border = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]]))[: len(item)]
                    place = np.arange(len(item)) - np.repeat(border, np.diff(np.append(border, len(item))))
                    for i, s, ok, doc in zip(*(x[place < top].tolist() for x in (item, score, own_known[r], own_ids[r])), strict=True):
                        heap, entry = heaps[i], (s, ok, -doc)
                        if len(heap) < top:
                            heapq.heappush(heap, entry)
                        else:
                            heapq.heappushpop(heap, entry)
                        if len(heap) == top:
                            least[i] = heap[0][0]
        rows = [(i, block.ids[i], -doc if ok else None, s) for i, heap in enumerate(heaps) for s, ok, doc in heap]
        columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["slot", "item_id", "doc_id", "score"])

    return run


def _best(docs: DataFrame, block: Block, top: int) -> DataFrame:
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(block)
    counted = docs.select("text").mapInArrow(_stats_batches(held), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    counts = dict(tuple(r) for r in counted.collect())  # two totals and a row for each term of the block
    n_docs, n_terms = counts.get(-2, 0), counts.get(-1, 0)
    df = np.array([counts.get(t, 0) for t in range(len(block.hashes))], np.int64)
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    near = docs.mapInArrow(_score_batches(held, weights, n_docs, max(n_terms, 1), top), "slot int, item_id long, doc_id long, score long")
    order = W.partitionBy("slot").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's ``top`` best documents. Counting runs when this is called."""
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    asked = items.select(F.col(item_id).cast("long").alias("item_id"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("text")).distinct()
    size = asked.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    blocks = max(1, math.ceil(size["n"] / BLOCK_ITEMS), math.ceil(size["bytes"] / BLOCK_BYTES))
    out = None
    for i in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i).orderBy("item_id", "text").collect()  # one block
        best = _best(own, block_of([tuple(r) for r in rows]), top)
        out = best if out is None else out.unionByName(best)
    return out
