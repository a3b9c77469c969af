"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint is cut into three segments, so two fingerprints that differ in at most
four bits have a segment that differs in at most one. Each segment is indexed once for
each of its bits with that bit left out: 64 variants a fingerprint. Fingerprints
that share a variant are equi-joined and verified.

Two uses: ``near_duplicates`` links fingerprints (of four-word shingles) at four or fewer differing bits. ``keep_one`` links texts whose
sets of five-word shingles have a Jaccard similarity of 0.8 or more. There a pair's fingerprints differ in about 15 % of their bits,
so each text has several independent fingerprints, a shared variant of any of them makes a candidate, and each candidate is verified by exact similarity.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from gleaner.llm.textvec import CHUNK_BYTES, IS_SPACE, LOWER, _mix, prefix_hash, span_hash, spans, stretches, text_chunks
from gleaner.operators.graph import connected_components
from gleaner.session import materialise

SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit, bits
MAX_BITS = 4
WORDS, SIMILARITY = 5, 0.8
PRINTS = 4  # fingerprints of a text in keep_one
CHECK_BITS = 22  # of a candidate's other fingerprints that may differ: at similarity 0.8 more differ once in 100,000 pairs
CROWD = 64  # nodes of a key that are compared with each other at once, about
SAMPLED = 16  # a key is crowded if the nodes whose hash is in one of so many parts of its range make up this part of a crowd
LIKELY_BITS = 10  # of a check fingerprint that differ at similarity 0.8, on average
BLOCK = 500  # nodes of a crowded key that are compared in one task with as many others

_PLACE = _mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def fingerprint(text: bytes | np.ndarray, words: int = 4, seed: int = 42) -> int:
    """SimHash of the word shingles of a text as an unsigned number; no words: 0. A long text is hashed a stretch at a time."""
    buf = np.frombuffer(text, np.uint8) if isinstance(text, bytes) else text
    digest = xxhash.xxh64_intdigest
    ones, count, tail = np.zeros(64, np.int64), 0, []

    def add(joined: bytes, k: int) -> None:
        nonlocal ones, count
        gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
        starts = np.concatenate([[0], gaps + 1])
        ends = np.concatenate([gaps, [len(joined)]])
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts[: len(starts) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], ">u8")
        for part in np.array_split(hashes, len(hashes) // 16384 + 1):
            ones += np.unpackbits(part.view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
        count += len(hashes)

    for a, b in stretches(buf, IS_SPACE):
        tokens = tail + buf[a:b].tobytes().lower().split()
        if len(tokens) >= words:
            add(b" ".join(tokens), words)
        tail = tokens[max(0, len(tokens) - words + 1) :]
    if not count and tail:
        add(b" ".join(tail), len(tail))
    return int.from_bytes(np.packbits(2 * ones > count).tobytes(), "big")


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = [fingerprint(buf[i:j]) for _, _, buf, offsets in text_chunks(batch.column(1)) for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(prints, np.uint64).view(np.int64))], ["id", "fp"])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, fp``: a 64-bit fingerprint (held as a signed long) for every row.

    Null and empty texts, and texts of white space, have fingerprint 0. Very long texts are
    hashed whole. Repeated rows stay repeated; other columns are not read.
    """
    src = df.select(df[id_col].cast("long").alias("id"), df[text_col].cast("string").alias("text"))
    return src.mapInArrow(_fingerprint_batches, "id long, fp long")


def variants(fp: Column) -> Column:
    """The 64 keys of a fingerprint: the left-out bit, then its segment without that bit."""
    keys = []
    for first, bits in SEGMENTS:
        segment = F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << bits) - 1))
        for i in range(bits):
            keys.append(F.lit((first + i) << 32) + segment.bitwiseAND(F.lit(((1 << bits) - 1) ^ (1 << i))))
    return F.array(*keys)


def links(prints: DataFrame, fp: str = "fp") -> DataFrame:
    """``a, b`` (a < b): every pair of different fingerprints at most four bits apart, once.

    Equal fingerprints are one node, so a group of copies costs one row whatever its size.
    A pair is emitted at the first variant that it shares. The variants meet by a merge: Spark sizes them as the nodes before they are exploded, so it would
    broadcast 64 times as much as it means to.
    """
    nodes = prints.select(F.col(fp).alias("fp")).where("fp is not null").distinct()
    nodes = nodes.repartition(prints.sparkSession.sparkContext.defaultParallelism, "fp")  # few bytes, but 64 times as many rows in the next step
    keyed = nodes.select("fp", F.explode(variants(F.col("fp"))).alias("key"))
    a, b = keyed.select(F.col("fp").alias("a"), "key"), keyed.select(F.col("fp").alias("b"), "key")
    diff = F.col("a").bitwiseXOR(F.col("b"))
    part = [F.shiftrightunsigned(diff, first).bitwiseAND(F.lit((1 << bits) - 1)) for first, bits in SEGMENTS]
    near = [F.bit_count(p) <= 1 for p in part]
    slot = F.shiftright("key", 32)
    first_shared = F.lit(False)
    for i in reversed(range(len(SEGMENTS))):
        low = SEGMENTS[i][0]
        bit = F.when(part[i] == 0, F.lit(low)).otherwise(F.lit(low) + F.bit_count(part[i] - F.lit(1)))
        first_shared = F.when(near[i], slot == bit).otherwise(first_shared)
    return a.hint("merge").join(b.hint("merge"), "key").where((F.col("a") < F.col("b")) & (F.bit_count(diff) <= MAX_BITS) & first_shared).select("a", "b")


def roots(prints: DataFrame) -> DataFrame:
    """``fp, low, root``: each distinct fingerprint with its smallest id and the smallest fingerprint that it reaches, as a written table.

    ``prints`` (``id, fp``) is read twice, so pass a written table. Rows are combined by fingerprint before any
    join, so a group of copies of any size is one row.
    """
    found = connected_components(materialise(links(prints), "simhash-links"))
    by_fp = prints.groupBy("fp").agg(F.min("id").alias("low"))
    labelled = by_fp.join(found, by_fp.fp == found.node, "left").select("fp", "low", F.coalesce("component", "fp").alias("root"))
    return materialise(labelled, "simhash-roots")


def components(prints: DataFrame) -> DataFrame:
    """Add ``component_id`` to ``id, fp`` rows: the smallest id reachable over links, its own included.

    A component whose ids are all null has a null id.
    """
    labelled = roots(prints)  # written, so that the join below can split a root with many fingerprints
    ids = labelled.groupBy("root").agg(F.min("low").alias("component_id"))
    of = labelled.join(ids, "root").select("fp", "root", "component_id")
    return prints.join(of, "fp").select("id", "fp", "root", "component_id")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row; see ``fingerprints`` and ``components``.

    An empty table gives an empty result.
    """
    prints = materialise(fingerprints(df, id_col, text_col), "simhash-prints")
    return components(prints).select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _whole_shingles(buf: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    low = LOWER[buf]
    starts, ends, row = spans(~IS_SPACE[low], offsets)
    word = span_hash(prefix_hash(low), starts, ends)
    count = np.bincount(row, minlength=len(offsets) - 1)
    sizes = np.where(count > 0, np.maximum(count - words + 1, 1), 0)
    last = np.repeat(np.cumsum(count), sizes)
    at = np.repeat(np.cumsum(count) - count - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    total = np.zeros(len(at), np.uint64)
    for j in range(words):
        inside = at + j < last
        total[inside] += word[at[inside] + j] * _PLACE[j]
    return _mix(total), sizes


def shingle_hashes(buf: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every row's word shingles, in order and with repeats, and how many each row has.

    Words are parted by ASCII white space, A-Z lowered. A row of fewer words than ``words`` is one shingle, one without words has none.
    A long text alone is hashed a stretch at a time.
    """
    if len(offsets) > 2 or len(buf) <= CHUNK_BYTES:
        return _whole_shingles(buf, offsets, words)
    parts, begin = [], 0
    for _, b in stretches(buf, IS_SPACE):
        starts = spans(~IS_SPACE[buf[begin:b]], np.array([0, b - begin]))[0]
        if len(starts) >= words or (b == len(buf) and not parts):
            parts.append(_whole_shingles(buf[begin:b], np.array([0, b - begin]), words)[0])
        if len(starts) >= words:
            begin += int(starts[len(starts) - words + 1]) if words > 1 else b - begin
    hashes = np.concatenate(parts)
    return hashes, np.array([len(hashes)])


def several_prints(hashes: np.ndarray, prints: int) -> np.ndarray:
    """Independent fingerprints of a set of shingle hashes."""
    ones = np.zeros(64 * prints, np.int64)
    for at in range(0, len(hashes), 255):  # counts that fit a byte
        mixed = _mix(hashes[at : at + 255, None] * _PLACE[None, :prints])
        ones += np.unpackbits(mixed.view(np.uint8), axis=1).sum(0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes)).view(np.uint64)


def _print_batches(words: int, prints: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, offsets in text_chunks(batch.column(2)):
                hashes, sizes = shingle_hashes(buf, offsets, words)
                ends = np.cumsum(sizes)
                node, fps = np.zeros(b - a, np.uint64), np.zeros((b - a, prints), np.uint64)
                for i in np.flatnonzero(sizes):
                    own = hashes[ends[i] - sizes[i] : ends[i]]
                    node[i] = _mix(_mix(own ^ _PLACE[0]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(own)))[0]
                    fps[i] = several_prints(np.unique(own), prints)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * prints), pa.array(fps.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(node.view(np.int64)), lists], ["id", "key", "node", "fps"])

    return run


def _similar_batches(words: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sets(column: pa.Array) -> Iterator[np.ndarray]:
            for _, _, buf, offsets in text_chunks(column):
                hashes, sizes = shingle_hashes(buf, offsets, words)
                yield from (np.unique(x) for x in np.split(hashes, np.cumsum(sizes)[:-1]))

        for batch in batches:
            near = []
            for x, y in zip(sets(batch.column(2)), sets(batch.column(3)), strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                near.append(both >= similarity * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(near, pa.bool_()))

    return run


def _verified(pairs: DataFrame, texts: Callable[[DataFrame], DataFrame], words: int, similarity: float) -> DataFrame:
    """The written rows of ``a, b`` (written) whose texts have sets of shingles of at least the Jaccard similarity."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    of = materialise(texts(asked), "simhash-texts")
    left, right = (of.select(F.col("node").alias(n), F.col("text").alias(f"text_{n}")) for n in "ab")
    met = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return materialise(met.mapInArrow(_similar_batches(words, similarity), "a long, b long"), "simhash-near")


def _linked(pairs: DataFrame, known: DataFrame | None, texts: Callable[[DataFrame], DataFrame], words: int, similarity: float) -> DataFrame:
    """The verified pairs of ``a, b, bits`` (written) that matter, with ``known`` ones: first one for each node, the likely one of the smallest other node, then one for each
    that is left between two components, then all that are left. A pair within a component needs no look."""
    near = known
    for last in (False, False, True):
        if near is not None:
            found = materialise(connected_components(near), "simhash-found")
            of = lambda df, node, name, found=found: df.join(found.select(F.col("node").alias(node), F.col("component").alias(name)), node, "left").withColumn(name, F.coalesce(name, node))
            pairs = of(of(pairs, "a", "own"), "b", "other").where(F.col("own") != F.col("other")).select("a", "b", "bits")
            pairs = materialise(pairs, "simhash-open")
            if pairs.isEmpty():
                break
        asked = pairs.select("a", "b")
        if not last:
            asked = materialise(pairs.groupBy("b").agg(F.min_by("a", F.struct(F.col("bits") > LIKELY_BITS, "a")).alias("a")).select("a", "b"), "simhash-asked")
            pairs = pairs.join(asked, ["a", "b"], "left_anti")
        got = _verified(asked, texts, words, similarity)
        near = got if near is None else near.unionByName(got)
    return near


def similar_links(
    nodes: DataFrame, texts: Callable[[DataFrame], DataFrame], words: int = WORDS, similarity: float = SIMILARITY, crowd: int = CROWD, sampled: int = SAMPLED, block: int = BLOCK
) -> DataFrame:
    """``node, component`` over the pairs of nodes (``node, fps``, each once, written) of at least the similarity; nodes that are alone do not appear.

    ``texts`` gives ``node, text`` for a table of nodes. Nodes that share a key are a candidate where their check fingerprints are near. Of a crowded
    key (see ``SAMPLED``) all nodes first meet its smallest one; those which the verified links leave in another component are then compared with all
    others of the key, in blocks, so a large group of near copies costs no pairs of its own. How a key is treated changes no result.
    """
    size = F.size("fps")
    checked = F.transform(
        F.col("fps"),
        lambda fp, i: F.struct(F.element_at("fps", (i + 1) % size + 1).alias("check"), F.transform(variants(fp), lambda key: F.shiftleft(i.cast("long"), 40).bitwiseOR(key)).alias("keys")),
    )
    spread = nodes.where("node <> 0").repartition(nodes.sparkSession.sparkContext.defaultParallelism, "node")
    each = spread.select("node", F.explode(checked).alias("c")).select("node", "c.check", F.explode("c.keys").alias("key"))
    part = each.where(F.pmod(F.xxhash64(F.lit(7), "node"), F.lit(sampled)) == 0)
    hot = materialise(part.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") * sampled >= crowd).select("key"), "simhash-crowded")
    bits = lambda x, y: F.bit_count(F.col(x).bitwiseXOR(F.col(y)))
    cold = each.join(hot, "key", "left_anti")
    left, right = (cold.select("key", F.col("node").alias(n), F.col("check").alias(f"check_{n}")) for n in "ab")
    pairs = left.join(right, "key").where((F.col("a") < F.col("b")) & (bits("check_a", "check_b") <= CHECK_BITS)).select("a", "b", bits("check_a", "check_b").alias("bits"))
    many = materialise(each.join(hot, "key", "left_semi"), "simhash-crowds")
    reps = many.groupBy("key").agg(F.min(F.struct("node", "check")).alias("rep")).select("key", F.col("rep.node").alias("a"), F.col("rep.check").alias("check_a"))
    met = many.select("key", F.col("node").alias("b"), F.col("check").alias("check_b")).join(materialise(reps, "simhash-first"), "key")
    star = met.where((F.col("a") < F.col("b")) & (bits("check_a", "check_b") <= CHECK_BITS)).select("a", "b", bits("check_a", "check_b").alias("bits"))
    pairs = materialise(pairs.unionByName(star).groupBy("a", "b").agg(F.min("bits").alias("bits")), "simhash-candidates")
    near = _linked(pairs, None, texts, words, similarity)
    if many.isEmpty():
        return connected_components(near)

    found = materialise(connected_components(near), "simhash-found")
    placed = many.join(found.select("node", F.col("component").alias("own")), "node", "left").withColumn("own", F.coalesce("own", "node"))
    placed = materialise(placed, "simhash-placed")
    crowds = placed.groupBy("key").agg(F.count("*").alias("n"), F.min("own").alias("one"), F.max("own").alias("two")).where("one <> two").select("key", F.ceil(F.col("n") / block).alias("blocks"))
    dealt = placed.join(materialise(crowds, "simhash-open"), "key").withColumn("part", F.pmod(F.xxhash64("node"), F.col("blocks")))
    dealt = dealt.select("key", "node", "check", "own", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("key", "node", "check", "own", "part", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))
    left, right = (dealt.select("key", "low", "high", *(F.col(c).alias(f"{c}_{n}") for c in ("node", "check", "own", "part"))) for n in "ab")
    met = left.join(right, ["key", "low", "high"]).where((F.col("node_a") < F.col("node_b")) & (F.col("own_a") != F.col("own_b")) & (bits("check_a", "check_b") <= CHECK_BITS))
    met = met.where((F.col("low") == F.col("high")) | (F.col("part_a") != F.col("part_b"))).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"), bits("check_a", "check_b").alias("bits"))
    more = met.groupBy("a", "b").agg(F.min("bits").alias("bits")).join(pairs.select("a", "b"), ["a", "b"], "left_anti")
    return connected_components(_linked(materialise(more, "simhash-candidates"), near, texts, words, similarity))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY, prints: int = PRINTS, crowd: int = CROWD, sampled: int = SAMPLED, block: int = BLOCK) -> DataFrame:
    """The rows of ``df`` with one row left of each group of near copies: the one of the smallest id (null ids last).

    Texts are linked from the given Jaccard similarity of their sets of word shingles on; a group is all that links reach. Each link is
    exact; with ``prints`` fingerprints a pair is found with probability 0.85 at similarity 0.8, 0.95 at 0.85 and 0.99 at 0.9, and always where the sets are equal.
    Null texts, empty texts and texts of white space are one group. Rows that repeat an id stand or fall by their text; of equal rows one stays. Other
    columns stay as they are. An empty table gives an empty result.
    """
    text = F.coalesce(df[text_col].cast("string"), F.lit(""))
    keyed = df.withColumn("__key", F.concat_ws(":", F.coalesce(df[id_col].cast("string"), F.lit("")), F.md5(text)))
    src = keyed.select(keyed[id_col].cast("long").alias("id"), "__key", keyed[text_col].cast("string").alias("text"))
    found = materialise(src.mapInArrow(_print_batches(words, prints), "id long, key string, node long, fps array<long>"), "simhash-keyed")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key"))
    each = materialise(found.groupBy("node").agg(first.alias("s"), F.first("fps").alias("fps")), "simhash-nodes")

    def texts(asked: DataFrame) -> DataFrame:
        wanted = materialise(each.join(asked, "node").select(F.col("s.key").alias("__key"), "node"), "simhash-asked")
        return src.join(wanted, "__key").dropDuplicates(["node"]).select("node", "text")

    linked = similar_links(each.select("node", "fps"), texts, words, similarity, crowd, sampled, block)
    rooted = each.join(linked, "node", "left").select("s", F.coalesce("component", "node").alias("root"))
    chosen = rooted.groupBy("root").agg(F.min("s").alias("s")).select(F.col("s.key").alias("__key"))
    return keyed.dropDuplicates(["__key"]).join(chosen, "__key", "left_semi").select(*df.columns)  # one shuffle by the key does for both
