"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

The pieces and their scores come from a model file. A model of merges holds ranks instead of
log probabilities; its pieces then get the log probabilities of Zipf's law over those
ranks (``scores="zipf"``), or keep the file's numbers (``scores="file"``).

Texts are normalised as the file says (dummy prefix, white space as the marker) and cut
before every marker that follows another character. No piece of the file may cross such
a cut (checked on loading), so the best path of a text is that of its parts. Each distinct part of a chunk is solved once, all
parts in lockstep: all trie matches at all positions, then the best score at each
position in turn; a part beyond ``LONG`` bytes (text without white space) goes by itself, in windows. Ties go to the longer last piece. A character without a path becomes its
byte pieces.
"""

from __future__ import annotations

import struct
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from gleaner.llm.textvec import prefix_hash, span_hash, text_chunks

MARKER = "▁"
_MARK = MARKER.encode()
SPACE = 32  # stands for the marker inside the trie
CHUNK_BYTES = 1 << 20
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # fixed values of the format
UNIGRAM = 1
UNKNOWN_PENALTY = 10.0
LONG = 2048  # bytes of a part that is solved by itself, position after position, in place of side by side with others
WINDOW = 1 << 16  # positions of it whose edges are held at once


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a message's fields: ints, or bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(raw):
        key = varint()
        wire = key & 7
        if wire == 0:
            yield key >> 3, varint()
        else:
            size = varint() if wire == 2 else 4 if wire == 5 else 8
            yield key >> 3, raw[at : at + size]
            at += size


class Model(NamedTuple):
    """Pieces by id, kinds and scores; the trie (base, check, id at each unit, -1: none); byte piece ids; flags."""

    pieces: list[bytes]
    kinds: np.ndarray
    scores: np.ndarray
    base: np.ndarray
    check: np.ndarray
    at: np.ndarray
    byte_ids: np.ndarray
    unknown_id: int
    unknown_score: float
    has_user: bool
    dummy_prefix: bool
    squeeze: bool
    sizes: np.ndarray  # of the pieces in bytes, a marker as one


def double_array(keys: list[bytes], values: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A double-array trie: unit s steps by byte c to ``base[s] + c`` if ``check`` there is s; ``at`` holds the value of a key's last unit."""
    order = sorted(range(len(keys)), key=lambda i: keys[i])
    size = 1 << 16
    base, check, at = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    taken = np.zeros(size, bool)
    taken[0] = True
    check[0] = 0
    lowest = 256
    todo = [(0, 0, len(order), 0)]  # unit, first and last key, depth
    while todo:
        unit, lo, hi, depth = todo.pop()
        groups = []
        i = lo
        while i < hi:
            k = keys[order[i]]
            if len(k) == depth:
                at[unit] = values[order[i]]
                i += 1
                continue
            c, j = k[depth], i + 1
            while j < hi and keys[order[j]][depth] == c:
                j += 1
            groups.append((c, i, j))
            i = j
        if not groups:
            continue
        codes = np.array([g[0] for g in groups])
        start = max(lowest - int(codes[0]), 1)
        if start + 8192 >= len(base):
            base, check, at, taken = (np.concatenate([x, np.full(len(x), fill, x.dtype)]) for x, fill in ((base, 0), (check, -1), (at, -1), (taken, False)))
        while len(groups) == 1 and taken[start + codes[0]]:
            start += 1
        while len(groups) > 1:
            if start + 4096 + 256 >= len(base):
                base, check, at, taken = (np.concatenate([x, np.full(len(x), fill, x.dtype)]) for x, fill in ((base, 0), (check, -1), (at, -1), (taken, False)))
            window = np.arange(start, start + 4096)
            free = ~taken[window + codes[0]]
            for c in codes[1:]:
                free &= ~taken[window + c]
            hit = np.flatnonzero(free)
            if len(hit):
                start = int(window[hit[0]])
                break
            start += 4096
        base[unit] = start
        taken[start + codes] = True
        check[start + codes] = unit
        while taken[lowest]:
            lowest += 1
        todo += [(start + c, i, j, depth + 1) for c, i, j in groups]
    top = int(np.flatnonzero(taken).max()) + 257
    return base[:top].copy(), check[:top].copy(), at[:top].copy()


def load(raw: bytes, scores: str = "auto") -> Model:
    """Read a model file. ``scores``: ``file``, ``zipf``, or ``auto`` (the file's for a unigram model, else Zipf's)."""
    pieces, values, kinds, model_type, flags = [], [], [], UNIGRAM, {3: 1, 4: 1}
    for number, value in _fields(raw):
        if number == 1:
            own = dict(_fields(value))
            pieces.append(own.get(1, b""))
            values.append(struct.unpack("<f", own.get(2, b"\0\0\0\0"))[0])
            kinds.append(own.get(3, NORMAL))
        elif number == 2:
            model_type = dict(_fields(value)).get(3, UNIGRAM)
        elif number == 3:
            own = dict(_fields(value))
            if own.get(2):
                raise ValueError("character maps of normalisers are not read")
            flags |= {k: v for k, v in own.items() if isinstance(v, int)}
    kinds, score = np.array(kinds), np.array(values, np.float32)
    if scores == "zipf" or scores == "auto" and model_type != UNIGRAM:
        ranked = np.flatnonzero(kinds == NORMAL)
        ranked = ranked[np.argsort(-score[ranked], kind="stable")]
        rank = np.arange(1, len(ranked) + 1)
        score[ranked] = -np.log(rank) - np.log((1 / rank).sum())
    usable = np.flatnonzero((kinds == NORMAL) | (kinds == USER))
    keys = [pieces[i].replace(_MARK, b" ") for i in usable]
    if b" " not in keys:
        raise ValueError("there is no piece for the marker alone")
    if any(b" " in k.lstrip(b" ") for k in keys):
        raise ValueError("a piece has a marker behind another character")
    base, check, at = double_array(keys, usable.tolist())
    byte_ids = np.full(256, -1)
    for i in np.flatnonzero(kinds == BYTE):
        byte_ids[int(pieces[i][3:5], 16)] = i
    normal = score[kinds == NORMAL]
    return Model(
        pieces,
        kinds,
        score,
        base,
        check,
        at,
        byte_ids,
        int(np.flatnonzero(kinds == UNKNOWN)[0]) if (kinds == UNKNOWN).any() else 0,
        float(np.float32(normal.min() if len(normal) else 0) - np.float32(UNKNOWN_PENALTY)),
        bool((kinds == USER).any()),
        bool(flags[3]),
        bool(flags[4]),
        np.array([len(p.replace(_MARK, b" ")) for p in pieces], np.int64),
    )


def _edges(buf: np.ndarray, stop: np.ndarray, m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, piece) of every match at every position of the parts; ``stop``: the end of the part that holds each position."""
    pos, unit = np.arange(len(buf)), np.zeros(len(buf), np.int32)
    found, depth = [], 0
    while len(pos):
        nxt = m.base[unit] + buf[pos + depth]
        ok = m.check[nxt] == unit
        pos, unit = pos[ok], nxt[ok]
        depth += 1
        value = m.at[unit]
        hit = value >= 0
        found.append((pos[hit], np.full(int(hit.sum()), depth), value[hit]))
        inside = pos + depth < stop[pos]
        pos, unit = pos[inside], unit[inside]
    start, length, piece = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
    return start, start + length, piece


def _lattice(buf: np.ndarray, starts: np.ndarray, stop: np.ndarray, m: Model, reach: int = 0, upto: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(start, end, piece) of the edges that a path may take, -1 for an unknown character, and where the last user's piece that begins before ``upto`` ends.

    ``starts``: of the parts; ``reach``: what a user's piece from before covers.
    """
    n = len(buf)
    a, b, piece = _edges(buf, stop, m)
    user = np.flatnonzero(m.kinds[piece] == USER) if m.has_user else np.zeros(0, np.int64)
    covered, after = reach > 0, reach
    if len(user) or covered:  # a user's piece is taken wherever it stands, the first and longest one first: no other edge overlaps it
        cover, own = np.zeros(n + 1, np.int64), np.zeros(len(a), bool)
        cover[1 : reach + 1] = 1
        for i in user[np.lexsort((-b[user], a[user]))].tolist():
            if a[i] >= reach:
                reach, own[i] = int(b[i]), True
                cover[a[i] + 1 : reach + 1] = 1
                after = reach if upto is None or a[i] < upto else after
        cover = np.cumsum(cover)
        ok = own | (cover[b] == cover[a])
        a, b, piece = a[ok], b[ok], piece[ok]
    # an unknown character: one edge over its bytes where no piece is just that character
    lead = (buf & 0xC0) != 0x80
    lead[starts] = True
    chars = np.flatnonzero(lead)
    char_end = np.minimum(np.concatenate([chars[1:], [n]]), stop[chars])
    single = np.zeros(n, np.int64)
    single[chars] = char_end
    known = np.zeros(n, bool)
    known[a[b == single[a]]] = True
    if len(user) or covered:
        known[:n] |= cover[1:] > cover[:-1]
    lone = ~known[chars]
    a = np.concatenate([a, chars[lone]])
    b = np.concatenate([b, char_end[lone]])
    piece = np.concatenate([piece, np.full(int(lone.sum()), -1)])
    usable = lead[a]
    return a[usable], b[usable], piece[usable], after


def _ids(piece: np.ndarray, width: np.ndarray, raw: np.ndarray, m: Model) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of a path, and how many each of its pieces has: -1 becomes its byte pieces, or the unknown piece where the model has none. ``raw``: the bytes of the unknown characters."""
    if not (piece < 0).any():
        return piece, np.ones(len(piece), np.int64)
    if not (m.byte_ids >= 0).all():
        return np.where(piece < 0, m.unknown_id, piece), np.ones(len(piece), np.int64)
    many = np.where(piece < 0, width, 1)
    flat = np.repeat(piece, many)
    flat[flat < 0] = m.byte_ids[raw]
    return flat, many


def solve_long(buf: np.ndarray, m: Model) -> np.ndarray:
    """Token ids of one long part: the same search, position after position, a window at a time.

    Held for the whole part are its bytes and one number for each of them; scores are 32-bit as in ``solve``.
    """
    n, longest = len(buf), int(m.sizes.max(initial=1))
    longest = max(longest, 4)
    came = array("i", bytes(4 * (n + 1)))
    low = float("-inf")
    best = array("f", [0.0])  # from the window's first position on
    reach = 0
    held = array("f", [0.0])
    for at in range(0, n, WINDOW):
        end = min(n, at + WINDOW + longest)
        part = buf[at:end]
        a, b, piece, after = _lattice(part, np.zeros(1 if at == 0 else 0, np.int64), np.full(len(part), len(part)), m, max(0, reach - at), WINDOW)
        reach = at + after
        own = a < WINDOW
        a, b, piece = a[own], b[own], piece[own]
        order = np.lexsort((a, b))
        a, b, piece = a[order], b[order], piece[order]
        score = np.where(piece >= 0, m.scores[piece], np.float32(m.unknown_score)).astype(np.float32)
        best.extend([low] * (end - at + 1 - len(best)))
        for x, y, more, p in zip(a.tolist(), b.tolist(), score.tolist(), piece.tolist(), strict=True):
            held[0] = best[x] + more
            if held[0] > best[y]:
                best[y] = held[0]
                came[at + y] = p
        best = best[WINDOW:]
    path, place = array("i"), n
    wide = m.sizes.tolist()
    raw = buf.tobytes()
    while place > 0:
        p = came[place]
        path.append(p)
        if p >= 0:
            place -= wide[p]
        else:
            place -= 1
            while place > 0 and raw[place] & 0xC0 == 0x80:
                place -= 1
    piece = np.frombuffer(path, np.int32)[::-1]
    if not (piece < 0).any():
        return piece
    ends = np.flatnonzero(piece < 0)
    width = m.sizes[np.maximum(piece, 0)]
    width[ends] = 0  # of the unknown characters: from the lead bytes
    lead = np.flatnonzero((buf & 0xC0) != 0x80)
    first, size = np.empty(len(ends), np.int64), np.empty(len(ends), np.int64)
    shift = 0
    known = np.cumsum(width)
    for i, e in enumerate(ends.tolist()):
        first[i] = int(known[e]) + shift
        j = int(np.searchsorted(lead, first[i], "right"))
        size[i] = (int(lead[j]) if j < len(lead) else n) - first[i]
        shift += int(size[i])
    width[ends] = size
    inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    return _ids(piece.astype(np.int64), width, buf[np.repeat(first, size) + inside], m)[0]


def solve(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, m: Model) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of the parts one after the other, and how many each has; the parts follow each other in ``buf``."""
    n = len(buf)
    part = np.repeat(np.arange(len(starts)), ends - starts)
    stop = ends[part]
    a, b, piece, _ = _lattice(buf, starts, stop, m)
    score = np.where(piece >= 0, m.scores[piece], np.float32(m.unknown_score)).astype(np.float32)

    # best score at each position, the parts in lockstep: edges by their end within the part, then part, then start
    of = part[a]
    depth = b - starts[of]
    order = np.lexsort((a, of, depth))
    a, b, piece, score, depth = a[order], b[order], piece[order], score[order], depth[order]
    group = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
    level = np.searchsorted(depth[group], np.arange(1, int(depth.max(initial=0)) + 2))
    best = np.zeros(n + 1, np.float32)  # of the path to each position; a part's first position is read before the last part's end is written
    came = np.zeros(n + 1, np.int64)
    bounds = np.concatenate([group, [len(a)]])
    fresh = a == starts[part[a]]
    for lo, hi in zip(level[:-1].tolist(), level[1:].tolist(), strict=True):
        if lo == hi:
            continue
        x, y = int(bounds[lo]), int(bounds[hi])
        value = np.where(fresh[x:y], np.float32(0), best[a[x:y]]) + score[x:y]
        first = bounds[lo:hi] - x
        top = np.maximum.reduceat(value, first)
        size = np.diff(np.concatenate([first, [y - x]]))
        hit = np.flatnonzero(value == np.repeat(top, size))
        at = b[x + hit]
        pick = hit[np.concatenate([[True], at[1:] != at[:-1]])]
        where = b[x + pick]
        best[where] = top
        came[where] = x + pick

    # back from the ends, all parts at once; an end inside the text is also a start of the next part, which is never walked to
    place, lane, out_lane, out_edge, step = ends.copy(), np.arange(len(starts)), [], [], []
    k = 0
    while len(lane):
        edge = came[place]
        out_lane.append(lane)
        out_edge.append(edge)
        step.append(np.full(len(lane), k))
        place = a[edge]
        on = place > starts[lane]
        place, lane = place[on], lane[on]
        k += 1
    if not out_lane:
        return np.zeros(0, np.int64), np.zeros(len(starts), np.int64)
    lane, edge, step = np.concatenate(out_lane), np.concatenate(out_edge), np.concatenate(step)
    order = np.lexsort((-step, lane))
    lane, edge = lane[order], edge[order]
    ids, width = piece[edge].astype(np.int64), b[edge] - a[edge]
    lost = ids < 0
    size = width[lost]
    raw = buf[np.repeat(a[edge][lost] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
    ids, many = _ids(ids, width, raw, m)
    return ids, np.bincount(np.repeat(lane, many), minlength=len(starts))


def _kept(keep: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Offsets after the bytes that are not to keep have gone."""
    if len(offsets) == 2:
        return np.array([0, int(np.count_nonzero(keep))])
    return np.concatenate([[0], np.cumsum(keep)])[offsets]


def _normalised(buf: np.ndarray, offsets: np.ndarray, m: Model) -> tuple[np.ndarray, np.ndarray]:
    """Texts with markers as single spaces and the dummy prefix; empty texts stay empty."""
    if len(buf) > 2:
        mark = np.flatnonzero((buf[:-2] == _MARK[0]) & (buf[1:-1] == _MARK[1]) & (buf[2:] == _MARK[2]))
        if len(mark):
            keep = np.ones(len(buf), bool)
            keep[mark + 1] = keep[mark + 2] = False
            buf = buf.copy()
            buf[mark] = SPACE
            offsets = _kept(keep, offsets)
            buf = buf[keep]
    if m.squeeze and len(buf):
        space = buf == SPACE
        before = np.concatenate([[True], space[:-1]])
        before[offsets[:-1][offsets[:-1] < len(buf)]] = True
        keep = ~(space & before)
        offsets = _kept(keep, offsets)
        buf = buf[keep]
        last = offsets[1:][np.diff(offsets) > 0] - 1
        keep = np.ones(len(buf), bool)
        keep[last[buf[last] == SPACE]] = False
        offsets = _kept(keep, offsets)
        buf = buf[keep]
    if m.dummy_prefix:
        full = np.diff(offsets) > 0
        buf = np.insert(buf, offsets[:-1][full], SPACE)
        offsets = np.concatenate([[0], np.cumsum(np.diff(offsets) + full)])
    return buf, offsets


def encode_chunk(buf: np.ndarray, offsets: np.ndarray, m: Model) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of the texts one after the other, and the bounds of each text's."""
    buf, offsets = _normalised(buf, offsets, m)
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    space = buf == SPACE
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    edge[1:n] |= space[1:] & ~space[:-1]
    cuts = np.flatnonzero(edge)
    out, bounds = [], []
    for a, b in _stretches(cuts):
        for i in [*(np.flatnonzero(np.diff(cuts[a : b + 1]) > LONG) + a).tolist(), b]:
            if a < i:
                ids, count = _encode_parts(buf[cuts[a] : cuts[i]], cuts[a:i] - cuts[a], cuts[a + 1 : i + 1] - cuts[a], m)
                out.append(ids.astype(np.int32))
                bounds.append(count)
            if i < b:
                out.append(solve_long(buf[cuts[i] : cuts[i + 1]], m).astype(np.int32))
                bounds.append(np.array([len(out[-1])]))
            a = i + 1
    ids, total = np.concatenate(out), np.concatenate([[0], np.cumsum(np.concatenate(bounds))])
    bounds = total[np.searchsorted(cuts[:-1], offsets)]
    if not (m.byte_ids >= 0).all():  # a run of unknown characters is one token
        again = np.zeros(len(ids), bool)
        again[1:] = (ids[1:] == m.unknown_id) & (ids[:-1] == m.unknown_id)
        again[bounds[bounds < len(ids)]] = False
        ids, bounds = ids[~again], bounds - np.concatenate([[0], np.cumsum(again)])[bounds]
    return ids, bounds


def _stretches(cuts: np.ndarray) -> Iterator[tuple[int, int]]:
    """First and last + 1 of runs of parts of about a chunk's bytes."""
    at = 0
    while at < len(cuts) - 1:
        to = min(max(at + 1, int(np.searchsorted(cuts, cuts[at] + CHUNK_BYTES, "right")) - 1), len(cuts) - 1)
        yield at, to
        at = to


def _encode_parts(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, m: Model) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of the parts one after the other, and how many each has; each distinct part is solved once."""
    code, unique = pd.factorize(span_hash(prefix_hash(buf), starts, ends))
    first = np.empty(len(unique), np.int64)
    first[code[::-1]] = np.arange(len(code))[::-1]
    size = (ends - starts)[first]
    at = np.cumsum(size) - size
    own = buf[np.repeat(starts[first] - at, size) + np.arange(int(size.sum()))]
    ids, count = solve(own, at, at + size, m)
    begin = np.cumsum(count) - count
    many = count[code]
    return ids[np.repeat(begin[code] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))], many


def decode_chunk(ids: np.ndarray, bounds: np.ndarray, m: Model) -> list[bytes]:
    """The UTF-8 texts of token ids: markers are spaces, byte pieces their bytes, control pieces nothing, the dummy prefix goes."""
    shown = [
        b"" if k == CONTROL else b" \xe2\x81\x87 " if k == UNKNOWN else bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(_MARK, b" ")
        for p, k in zip(m.pieces, m.kinds.tolist(), strict=True)
    ]
    size = np.array([len(x) for x in shown], np.int32)
    start = np.cumsum(size) - size
    flat = np.frombuffer(b"".join(shown), np.uint8)
    parts = []
    for a in range(0, len(ids), 1 << 18):
        own = ids[a : a + (1 << 18)]
        width = size[own]
        before = np.cumsum(width) - width
        parts.append(flat[np.repeat(start[own] - before, width) + np.arange(int(width.sum()))].tobytes())
    raw = b"".join(parts)
    end = np.concatenate([[0], np.cumsum(size[ids])])[bounds]
    byte_piece = np.concatenate([[0], np.cumsum(m.kinds[ids] == BYTE)])[bounds]
    out = []
    for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        text = raw[end[i] : end[i + 1]]
        if m.dummy_prefix and text[:1] == b" " and a < b and m.kinds[ids[a]] != BYTE:
            text = text[1:]
        if byte_piece[i + 1] > byte_piece[i]:
            text = text.decode("utf-8", "replace").encode()
        out.append(text)
    return out


def read_model(spark: SparkSession, path: str, scores: str = "auto") -> Model:
    """Load a model file from any path that Spark reads, or else from the driver's disk."""
    if "://" in path:
        return load(bytes(spark.read.format("binaryFile").load(path).select("content").first()[0]), scores)
    with open(path, "rb") as f:
        return load(f.read(), scores)


def encode(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids``: the token ids of every whole text (null and empty: none).

    Repeated rows stay repeated; null ids are kept; other columns are not read. Texts with invalid
    or very long words are solved alike.
    """
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, offsets in text_chunks(batch.column(1), CHUNK_BYTES):
                ids, bounds = encode_chunk(buf, offsets, held.value)
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], ["doc_id", "ids"])

    src = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, ids array<int>")


def decode(df: DataFrame, model: Model, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text`` from token ids (null: null). Ids outside the vocabulary fail the job."""
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            bounds = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
            ids = pc.list_flatten(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            if len(ids) and not 0 <= ids.min() <= ids.max() < len(held.value.pieces):
                raise ValueError("an id is outside the vocabulary")
            texts = [None if none else t for none, t in zip(lists.is_null().to_pylist(), decode_chunk(ids, bounds, held.value), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "text"])

    src = df.select(df[id_col].cast("long").alias("doc_id"), df[ids_col].cast("array<int>").alias("ids"))
    return src.mapInArrow(run, "doc_id long, text string")


def digest(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, n_byte_tokens, ids_sha256, decoded_sha256``: ``encode`` and ``decode`` of every text in one pass.

    ``ids_sha256`` is of the ids as little-endian 32-bit numbers, ``decoded_sha256`` of the text decoded from them.
    """
    import hashlib

    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, offsets in text_chunks(batch.column(1), CHUNK_BYTES):
                ids, bounds = encode_chunk(buf, offsets, held.value)
                texts = decode_chunk(ids, bounds, held.value)
                raw = memoryview(np.ascontiguousarray(ids, "<i4")).cast("B")
                by = np.concatenate([[0], np.cumsum(held.value.kinds[ids] == BYTE)]) if len(ids) else np.zeros(1, np.int64)
                sums = [hashlib.sha256(raw[4 * x : 4 * y]).hexdigest() for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(np.diff(bounds)), pa.array(by[bounds[1:]] - by[bounds[:-1]]), pa.array(sums), pa.array([hashlib.sha256(t).hexdigest() for t in texts])],
                    ["doc_id", "n_tokens", "n_byte_tokens", "ids_sha256", "decoded_sha256"],
                )

    src = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, n_tokens long, n_byte_tokens long, ids_sha256 string, decoded_sha256 string")
