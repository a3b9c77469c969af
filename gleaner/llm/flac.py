"""Media columns: FLAC streams written and read with numpy, many frames in lockstep.

``encode`` turns a binary payload column into a FLAC column (mono, 8 bits, blocks
of 192 samples, sample = byte - 128). ``decode`` reads any mono FLAC column of 4 to
24 bits: constant, verbatim, fixed and LPC subframes, both Rice codings with escapes,
fixed block sizes. It verifies the CRC-8 of every header, the CRC-16 of every
frame and the MD5 of the samples. A stream that fails any of these gets no PCM
and an ``error``; the rows beside it are not touched.

Frames may start where a header's sync and CRC-8 agree and its number, block size and bits
fit the stream, so all frames of all rows of a chunk decode together: the work per sample is a few array
operations. Bytes inside a frame can look like a header too; a stream's frames are the chain in which each
begins where the one before ends by its own code and CRC-16. Long streams are coded and decoded a stretch at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gleaner.llm.textvec import text_chunks

BLOCK = 192
SEEK_EVERY = 64
MAX_POINTS = 900_000  # a metadata block's length has 24 bits
CHUNK_BYTES = 1 << 20
STRETCH = 1 << 13  # frames that are coded in one go
SAMPLES = 1 << 21  # samples that are decoded in one go, at least one frame's

FIXED = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]  # fixed values of the format


def _crc_table(poly: int, bits: int) -> np.ndarray:
    t = np.arange(256, dtype=np.uint32) << (bits - 8)
    for _ in range(8):
        t = np.where(t >> (bits - 1) & 1, (t << 1) ^ poly, t << 1) & ((1 << bits) - 1)
    return t.astype(np.uint16)


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)
ZEROS16 = np.full(1 << 16, 16, np.uint8)
for _n in range(16):
    ZEROS16[1 << (15 - _n) : 1 << (16 - _n)] = _n


def _rows(buf: np.ndarray, ends: np.ndarray, width: int, lengths: np.ndarray) -> np.ndarray:
    """A matrix (width, n) of the last bytes before ``ends``, zero before each start."""
    at = ends[None, :] - width + np.arange(width)[:, None]
    return np.where(at >= (ends - lengths)[None, :], buf[np.maximum(at, 0)], 0)


def crc(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    """CRC of each span (initial value 0, so leading zeros change nothing)."""
    out = np.zeros(len(starts), np.uint16)
    if not len(starts):
        return out
    lengths = ends - starts
    order = np.argsort(lengths, kind="stable")
    for part in np.array_split(order, max(1, len(order) // 8192)):
        c = np.zeros(len(part), np.uint16)
        for row in _rows(buf, ends[part], int(lengths[part].max()), lengths[part]).astype(np.uint16):
            c = table[c ^ row] if table is CRC8 else table[(c >> 8) ^ row] ^ (c << 8)
        out[part] = c
    return out


def _digits(numbers: np.ndarray, width: int) -> np.ndarray:
    """Frame numbers in the extended UTF-8 coding of ``width`` bytes, a row each."""
    if width == 1:
        return numbers[:, None].astype(np.uint8)
    parts = [0x80 | numbers >> 6 * i & 63 for i in range(width - 2, -1, -1)]
    return np.stack([(0xFF00 >> width) & 0xFF | numbers >> 6 * (width - 1), *parts], 1).astype(np.uint8)


def _zigzag(r: np.ndarray) -> np.ndarray:
    return (r << 1) ^ (r >> 31)


def _rice(u: np.ndarray, skip: int) -> tuple[np.ndarray, np.ndarray]:
    """Best parameter and bits for each frame of zigzag residuals (samples, frames)."""
    best = np.full(u.shape[1], 1 << 30)
    arg = np.zeros(u.shape[1], np.int32)
    near = np.log2(u[skip:].sum(0) / (BLOCK - skip) + 1).astype(np.int32)
    for k in (np.clip(near + step, 0, 8) for step in (-1, 0, 1)):
        bits = (u[skip:] >> k).sum(0, dtype=np.int32) + (BLOCK - skip) * (k + 1)
        arg, best = np.where(bits < best, k, arg), np.minimum(best, bits)
    return arg, best


def _frames(x: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of frames with samples ``x`` (192, frames) and their frame numbers, and the size of each."""
    frames = x.shape[1]
    # candidates: verbatim, constant, fixed order 0 to 2, LPC of order 2
    best = np.full(frames, 8 * BLOCK)
    kind = np.ones(frames, np.int64)  # the format's subframe types
    rice = np.zeros(frames, np.int64)
    res = x.copy()
    for order in range(3):
        r = x.copy()
        for j, c in enumerate(FIXED[order], 1):
            r[j:] -= c * x[: BLOCK - j]
        u = _zigzag(r)
        k, bits = _rice(u, order)
        bits = bits + 8 * order + 10
        better = bits < best
        best, kind, rice = np.where(better, bits, best), np.where(better, 8 + order, kind), np.where(better, k, rice)
        res = np.where(better, u, res)
    f = x.astype(np.float32)
    r0, r1, r2 = (f * f).sum(0) + 1, (f[1:] * f[:-1]).sum(0), (f[2:] * f[:-2]).sum(0)
    det = np.maximum(r0 * r0 - r1 * r1, 1)
    q1 = np.clip(np.rint(32 * r1 * (r0 - r2) / det), -64, 63).astype(np.int32)
    q2 = np.clip(np.rint(32 * (r0 * r2 - r1 * r1) / det), -64, 63).astype(np.int32)
    r = x.copy()
    r[2:] -= (q1 * x[1:-1] + q2 * x[:-2]) >> 5
    u = _zigzag(r)
    k, bits = _rice(u, 2)
    bits = bits + 16 + 10 + 4 + 5 + 14
    better = bits < best
    best, kind, rice = np.where(better, bits, best), np.where(better, 33, kind), np.where(better, k, rice)
    res = np.where(better, u, res)
    same = (x == x[0]).all(0)
    kind, best = np.where(same, 0, kind), np.where(same, 8, best)

    width = 1 + (number >= 128) + (number >= 1 << 11) + (number >= 1 << 16) + (number >= 1 << 21) + (number >= 1 << 26)
    head = 5 + width
    size = head + (8 + best + 7) // 8 + 2
    end = np.cumsum(size)
    start = end - size
    bits = np.zeros(8 * int(end[-1]), np.uint8)

    def put(at: np.ndarray, value: np.ndarray, n: int) -> None:
        for b in range(n):
            bits[at + (n - 1 - b)] = (value >> b) & 1

    at = 8 * (start + head)
    put(at, kind << 1, 8)
    at = at + 8
    c = np.flatnonzero(kind == 0)
    put(at[c], x[0, c] & 255, 8)
    v = np.flatnonzero(kind == 1)
    if len(v):
        put(at[v][None, :] + 8 * np.arange(BLOCK)[:, None], x[:, v] & 255, 8)
    for code, order in ((8, 0), (9, 1), (10, 2), (33, 2)):
        w = np.flatnonzero(kind == code)
        if not len(w):
            continue
        p = at[w]
        for j in range(order):
            put(p, x[j, w] & 255, 8)
            p = p + 8
        if code == 33:
            put(p, np.full(len(w), 6), 4)  # 7-bit coefficients
            put(p + 4, np.full(len(w), 5), 5)
            put(p + 9, q1[w] & 127, 7)
            put(p + 16, q2[w] & 127, 7)
            p = p + 23
        put(p + 6, rice[w], 4)  # Rice coding 0, one partition
        k, u = rice[w], res[order:, w]
        stop = p + 10 + np.cumsum((u >> k) + k + 1, 0)
        bits[stop - k - 1] = 1
        for b in range(8):
            on = np.flatnonzero(k > b)
            if len(on) == len(w):
                bits[stop - 1 - b] = (u >> b) & 1
            elif len(on):
                bits[stop[:, on] - 1 - b] = (u[:, on] >> b) & 1
    out = np.packbits(bits)
    out[start], out[start + 1], out[start + 2], out[start + 3] = 0xFF, 0xF8, 0x10, 0x02
    for w in range(1, int(width.max()) + 1):
        on = np.flatnonzero(width == w)
        if len(on):
            out[start[on][:, None] + 4 + np.arange(w)] = _digits(number[on], w)
    out[start + head - 1] = crc(out, start, start + head - 1, CRC8)
    tail = crc(out, start, end - 2, CRC16)
    out[end - 2], out[end - 1] = tail >> 8, tail & 255
    return out, size


def encode_payloads(buf: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """FLAC streams of the payloads in ``buf``; their lengths are multiples of 192. Frames are coded a stretch at a time."""
    if len(buf) == 0 or np.any(np.diff(offsets) % BLOCK) or np.any(np.diff(offsets) == 0):
        raise ValueError("payload lengths must be positive multiples of 192")
    per = np.diff(offsets) // BLOCK
    first = np.concatenate([[0], np.cumsum(per)])
    parts, sizes = [], []
    for a in range(0, len(buf) // BLOCK, STRETCH):
        x = np.ascontiguousarray(buf[a * BLOCK : (a + STRETCH) * BLOCK].reshape(-1, BLOCK).T).astype(np.int32) - 128
        at = a + np.arange(x.shape[1])
        out, size = _frames(x, at - first[np.searchsorted(first, at, "right") - 1])
        parts.append(out.tobytes())
        sizes.append(size)
    size, raw = np.concatenate(sizes), b"".join(parts)
    start = np.concatenate([[0], np.cumsum(size)])
    streams = []
    for i in range(len(per)):
        a, n = int(first[i]), int(per[i])
        own = size[a : a + n]
        samples = buf[offsets[i] : offsets[i + 1]] ^ 128
        fields = (BLOCK << 16 | BLOCK) << 48 | int(own.min()) << 24 | int(own.max())
        fields = fields << 64 | 8000 << 44 | 0 << 41 | 7 << 36 | n * BLOCK
        info = fields.to_bytes(18, "big") + hashlib.md5(samples).digest()
        every = max(SEEK_EVERY, -(-n // MAX_POINTS))
        points = b"".join(
            (j * BLOCK).to_bytes(8, "big") + int(start[a + j] - start[a]).to_bytes(8, "big") + BLOCK.to_bytes(2, "big")
            for j in range(0, n, every)
        )
        streams.append(b"fLaC\x00\x00\x00\x22" + info + b"\x83" + len(points).to_bytes(3, "big") + points + raw[start[a] : start[a + n]])
    return streams


def _headers(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Frame headers that may start at ``at``: start, head length, frame number, block size, bits a sample."""
    at = at[at + 17 <= len(buf)]  # the caller pads the end
    b2, b3, b4 = buf[at + 2].astype(np.int64), buf[at + 3].astype(np.int64), buf[at + 4].astype(np.int64)
    size_code, rate_code = b2 >> 4, b2 & 15
    width = np.select([b4 < 0x80, b4 < 0xC0, b4 < 0xE0, b4 < 0xF0, b4 < 0xF8, b4 < 0xFC, b4 < 0xFE], [1, 0, 2, 3, 4, 5, 6], 0)
    ok = (size_code > 0) & (rate_code < 15) & (b3 >> 4 == 0) & (b3 & 1 == 0) & (width > 0)
    at, b3, size_code, rate_code, width, b4 = (z[ok] for z in (at, b3, size_code, rate_code, width, b4))
    number = np.where(width == 1, b4, b4 & ((1 << np.maximum(7 - width, 0)) - 1))
    for j in range(1, 6):
        number = np.where(width > j, number << 6 | buf[at + 4 + j] & 63, number)
    p = at + 4 + width
    extra = np.where(size_code == 6, 1, np.where(size_code == 7, 2, 0))
    block = np.where(size_code == 1, 192, np.where(size_code < 6, 576 << np.clip(size_code - 2, 0, 3), 256 << np.clip(size_code - 8, 0, 7)))
    block = np.where(size_code == 6, buf[p].astype(np.int64) + 1, block)
    block = np.where(size_code == 7, (buf[p].astype(np.int64) << 8 | buf[p + 1]) + 1, block)
    head = 4 + width + extra + np.select([rate_code == 12, rate_code > 12], [1, 2], 0) + 1
    bps = np.array([0, 8, 12, 0, 16, 20, 24, 0])[b3 >> 1 & 7]
    good = crc(buf, at, at + head - 1, CRC8) == buf[at + head - 1]
    return tuple(z[good] for z in (at, head, number, block, bps))


class _Bits:
    """Bit cursors of many lanes over one buffer."""

    def __init__(self, buf: np.ndarray, at: np.ndarray, limit: np.ndarray):
        padded = np.concatenate([buf, np.zeros(16, np.uint8)])
        self.words = np.lib.stride_tricks.sliding_window_view(padded, 8).copy().view(">u8")[:, 0].astype(np.uint64)
        self.last = len(self.words) - 1
        self.at, self.limit = at, limit  # where each lane is, and a bit that no sound frame gets to

    def window(self, lanes) -> np.ndarray:
        """At least 56 bits from each cursor, left-aligned."""
        at = self.at[lanes]
        return self.words[np.minimum(at >> 3, self.last)] << (at & 7).astype(np.uint64)

    def take(self, lanes, n) -> np.ndarray:
        """Unsigned numbers of ``n`` bits (0 to 56; a scalar or one for each lane)."""
        n = np.asarray(n, np.int64)
        w = self.window(lanes) >> np.uint64(1) >> (63 - n).astype(np.uint64)
        self.at[lanes] += n
        return w.astype(np.int64)

    def signed(self, lanes, n) -> np.ndarray:
        v, n = self.take(lanes, n), np.asarray(n, np.int64)
        return v - ((v >> np.maximum(n - 1, 0) & 1) << n)


def _subframes(buf: np.ndarray, at: np.ndarray, block: np.ndarray, bps: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Samples (block, frames), the byte after each subframe, and which frames are well formed; none is longer than ``bound`` bytes."""
    n, longest = len(at), int(block.max())
    s = np.zeros((longest, n), np.int64)
    bits = _Bits(buf, at * 8, (at + bound) * 8)
    every = np.arange(n)
    code = bits.take(every, 8)
    ok = (code >> 7) == 0
    kind, wasted = code >> 1 & 63, np.zeros(n, np.int64)
    for lane in np.flatnonzero(code & 1):
        while wasted[lane] < bps[lane] and bits.take(np.array([lane]), 1)[0] == 0:
            wasted[lane] += 1
        wasted[lane] += 1
    ok &= wasted < bps
    wasted = np.minimum(wasted, bps)
    bps = np.maximum(bps - wasted, 1)
    fixed, lpc = (kind >= 8) & (kind <= 12), kind >= 32
    ok &= (kind < 2) | fixed | lpc
    order = np.where(fixed, kind - 8, np.where(lpc, kind - 31, 0))
    ok &= order <= block

    on = np.flatnonzero(ok & (kind == 0))
    s[:, on] = bits.signed(on, bps[on])
    verbatim = np.flatnonzero(ok & (kind == 1))
    for t in range(longest if len(verbatim) else 0):
        on = verbatim[block[verbatim] > t]
        s[t, on] = bits.signed(on, bps[on])
    coded = ok & (fixed | lpc)
    for t in range(int(order[coded].max(initial=0))):
        on = np.flatnonzero(coded & (order > t))
        s[t, on] = bits.signed(on, bps[on])
    coef, shift = np.zeros((int(order[coded].max(initial=0)), n), np.int64), np.zeros(n, np.int64)
    for o in range(1, 5):
        with_order = np.flatnonzero(coded & fixed & (order == o))
        for j, c in enumerate(FIXED[o] if len(with_order) else []):
            coef[j, with_order] = c
    on = np.flatnonzero(coded & lpc)
    if len(on):
        precision = bits.take(on, 4) + 1
        shift[on] = bits.signed(on, 5)
        ok[on] &= (precision < 16) & (shift[on] >= 0)
        shift = np.maximum(shift, 0)
        for j in range(int(order[on].max())):
            more = order[on] > j
            coef[j, on[more]] = bits.signed(on[more], precision[more])
    lanes = np.flatnonzero(coded & ok)
    if len(lanes):
        method = bits.take(lanes, 2)
        parts = bits.take(lanes, 4)
        good = (method < 2) & (block[lanes] % (1 << parts) == 0) & (block[lanes] >> parts >= order[lanes])
        ok[lanes[~good]] = False
        lanes, method, parts = lanes[good], method[good], parts[good]
        _residuals(bits, s, lanes, method, block[lanes] >> parts, order, block)
        for o in np.unique(order[lanes]):
            if o:
                g = lanes[order[lanes] == o]
                x, c, sh = s[:, g], coef[:o, g], shift[g]
                for t in range(o, longest):
                    p = c[0] * x[t - 1]
                    for j in range(1, o):
                        p += c[j] * x[t - 1 - j]
                    x[t] += p >> sh
                s[:, g] = x
    if wasted.any():
        s <<= wasted
    return s, (bits.at + 7) // 8, ok


def _residuals(bits: _Bits, s: np.ndarray, lanes, method, part, order, block) -> None:
    """Rice codes of the lanes into ``s``, one sample of all lanes at a time."""
    left = part - order[lanes]  # samples up to the next parameter
    due = np.ones(len(lanes), bool)
    k, raw = np.zeros(len(lanes), np.int64), np.full(len(lanes), -1, np.int64)
    at, words, last = bits.at, bits.words, bits.last
    first, longest, shortest = int(order[lanes].max()), int(block[lanes].max()), int(block[lanes].min())
    for t in range(int(order[lanes].min()), longest):
        w = np.flatnonzero((order[lanes] <= t) & (block[lanes] > t)) if t < first or t >= shortest else slice(None)
        d = np.flatnonzero(due) if isinstance(w, slice) else w[due[w]]
        while len(d):
            width = 4 + method[d]
            k[d] = bits.take(lanes[d], width)
            escape = d[k[d] == (1 << width) - 1]
            raw[d] = -1
            if len(escape):
                raw[escape] = bits.take(lanes[escape], 5)
            due[d] = False
            d = d[left[d] == 0]  # an empty first partition: its parameter only
            left[d] = part[d]
        g = lanes[w]
        p = at[g]
        x = words[np.minimum(p >> 3, last)] << (p & 7).astype(np.uint64)
        q = ZEROS16[x >> np.uint64(48)].astype(np.int64)
        far = np.flatnonzero(q == 16)
        p = p + q + 1
        while len(far):
            p[far] -= 1
            y = words[np.minimum(p[far] >> 3, last)] << (p[far] & 7).astype(np.uint64)
            more = ZEROS16[y >> np.uint64(48)].astype(np.int64)
            q[far] += more
            p[far] += more + 1
            far = far[(more == 16) & (p[far] < bits.limit[g[far]])]
        kw = k[w]
        x = words[np.minimum(p >> 3, last)] << (p & 7).astype(np.uint64)
        u = q << kw | (x >> np.uint64(1) >> (63 - kw).astype(np.uint64)).astype(np.int64)
        value = (u >> 1) ^ -(u & 1)
        at_after = p + kw
        escaped = np.flatnonzero(raw[w] >= 0)
        if len(escaped):
            at_after[escaped] = at[g[escaped]]
        at[g] = at_after
        if len(escaped):
            value[escaped] = bits.signed(g[escaped], raw[w][escaped])
        s[t, g] = value
        left[w] -= 1
        out = np.flatnonzero(left == 0) if isinstance(w, slice) else w[left[w] == 0]
        due[out] = True
        left[out] = part[out]


class _Info(NamedTuple):
    """What a stream says of itself: samples (0: unknown), bits, block size, longest frame in bytes, MD5, first audio byte."""

    total: int
    bps: int
    block: int
    bound: int
    md5: bytes
    audio: int


def _info(raw: np.ndarray) -> _Info | str:
    """A stream's own description, or why it cannot be read."""
    if raw[:4].tobytes() != b"fLaC" or len(raw) < 42 or raw[4] & 127:
        return "not a FLAC stream"
    at, last = 4, 0
    while not last and at + 4 <= len(raw):
        last, size = raw[at] >> 7, int.from_bytes(raw[at + 1 : at + 4].tobytes(), "big")
        at += 4 + size
    v = int.from_bytes(raw[8:26].tobytes(), "big")
    total, bps, channels = v & (1 << 36) - 1, (v >> 36 & 31) + 1, (v >> 41 & 7) + 1
    longest, block = v >> 64 & (1 << 24) - 1, v >> 112 & 0xFFFF
    if channels != 1 or not 4 <= bps <= 24:
        return "only mono streams of 4 to 24 bits are read"
    return _Info(total, bps, max(block, 1), longest or 8 * (block * (bps + 1) // 8 + 32), raw[26:42].tobytes(), at)


def _decoded(buf: np.ndarray, start, head, size, bps: int, bound: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Samples (frames, block) of frames that may start at ``start``, the byte after each, and which of them CRC-16 confirms."""
    lo, hi = int(start[0]), min(len(buf) - 2, int(start[-1]) + bound + 8)
    samples, used, ok = _subframes(buf[lo:hi], start + head - lo, size, np.full(len(start), bps), bound)
    used += lo
    ok &= (used - start <= bound) & (used <= hi)
    on = np.flatnonzero(ok)
    ok[on] = crc(buf, start[on], used[on], CRC16) == (buf[used[on]].astype(np.uint16) << 8 | buf[used[on] + 1])
    return np.ascontiguousarray(samples.T.astype(np.int8 if bps <= 8 else np.int16 if bps <= 16 else np.int32)), used + 2, ok


def _chain(begin: np.ndarray, after: np.ndarray, sound: np.ndarray, number: np.ndarray, size: np.ndarray, info: _Info, at: int, end: int) -> np.ndarray | str:
    """Which candidates are a stream's frames: the first stands where the audio begins, each next one where the one before ends."""
    if len(begin) and sound.all() and begin[0] == at and after[-1] == end and np.array_equal(after[:-1], begin[1:]) and np.array_equal(number, np.arange(len(begin))):
        frames = np.arange(len(begin))
    else:
        place, frames = {b: j for j, b in enumerate(begin.tolist())}, []
        while at < end:
            j = place.get(at)
            if j is None or number[j] != len(frames):
                return f"frame {len(frames)} is missing"
            if not sound[j]:
                return f"frame {len(frames)} fails its checksum"
            frames.append(j)
            at = int(after[j])
        if at > end:
            return f"frame {len(frames) - 1} fails its checksum"
        frames = np.array(frames, np.int64)
    if (info.total and int(size[frames].sum()) != info.total) or (size[frames[:-1]] != info.block).any():
        return "frames are missing"
    return frames


def decode_streams(buf: np.ndarray, offsets: np.ndarray) -> list[dict]:
    """Decode the FLAC streams in ``buf``: mono, 4 to 24 bits, fixed block size.

    Each result has ``pcm`` (signed samples as int8, or little-endian int16/int32 beyond 8
    bits), ``blocks`` (first sample, byte offset of the frame, samples) and ``error`` (null if sound).
    Streams of variable block size or of two channels have an error. A frame is no longer than the stream says (8 times its plain size where it says nothing).
    """
    n = len(offsets) - 1
    out: list[dict] = [{"pcm": None, "blocks": [], "error": None} for _ in range(n)]
    infos = [_info(buf[offsets[i] : offsets[i + 1]]) for i in range(n)]
    for i, info in enumerate(infos):
        if isinstance(info, str):
            out[i]["error"] = info
    field = lambda name, other=0: np.array([other if isinstance(v, str) else getattr(v, name) for v in infos], np.int64)
    total, bits, block, bound, audio = field("total"), field("bps"), field("block", 1), field("bound"), field("audio", 1 << 60) + offsets[:-1]
    padded = np.concatenate([buf, np.zeros(32, np.uint8)])
    sync = np.flatnonzero((padded[:-1] == 0xFF) & (padded[1:] == 0xF8))
    owner = np.searchsorted(offsets, sync, "right") - 1
    sync = sync[sync >= audio[np.minimum(owner, n - 1)]]
    start, head, number, size, bps = _headers(padded, sync)
    # a header speaks for a frame only if its number, block and bits are those that the stream has there
    of = np.minimum(np.searchsorted(offsets, start, "right") - 1, n - 1)
    rest = np.where(total[of] > 0, total[of] - number * block[of], block[of])
    fits = (number <= (1 << 36) // block[of]) & np.where(total[of] > 0, size == np.minimum(block[of], rest), size <= block[of]) & ((bps == 0) | (bps == bits[of]))
    start, head, number, size, of = (z[fits] for z in (start, head, number, size, of))
    for b, w in sorted(set(zip(block[of].tolist(), bits[of].tolist(), strict=True))):
        own = np.flatnonzero((block[of] == b) & (bits[of] == w))
        step = max(1, SAMPLES // b)
        parts = [_decoded(padded, start[k], head[k], size[k], w, int(bound[of[k]].max())) for k in (own[j : j + step] for j in range(0, len(own), step))]
        samples = np.zeros((len(own), b), parts[0][0].dtype)
        for j, (x, _, _) in enumerate(parts):
            samples[j * step : j * step + len(x), : x.shape[1]] = x
        after, sound = (np.concatenate([p[j] for p in parts]) for j in (1, 2))
        edges = np.searchsorted(of[own], np.arange(n + 1))
        for i in np.unique(of[own]).tolist():
            k = slice(int(edges[i]), int(edges[i + 1]))
            at = own[k]
            found = _chain(start[at], after[k], sound[k], number[at], size[at], infos[i], int(audio[i]), int(offsets[i + 1]))
            if isinstance(found, str):
                out[i]["error"] = found
                continue
            whole = len(found) == len(at)
            pcm = (samples[k] if whole else samples[k][found]).reshape(-1)[: int(size[at[found]].sum())]
            digest = pcm if w <= 16 else pcm.view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
            if any(infos[i].md5) and hashlib.md5(digest).digest() != infos[i].md5:
                out[i]["error"] = "samples fail their MD5"
                continue
            out[i]["pcm"] = pcm
            out[i]["blocks"] = list(zip((number[at[found]] * b).tolist(), (start[at[found]] - offsets[i]).tolist(), size[at[found]].tolist(), strict=True))
    for i, info in enumerate(infos):
        if out[i]["error"] is None and out[i]["pcm"] is None:  # no header at all
            if audio[i] == offsets[i + 1] and not info.total:
                out[i]["pcm"] = np.zeros(0, np.int8 if info.bps <= 8 else np.int16 if info.bps <= 16 else np.int32)
            else:
                out[i]["error"] = "frame 0 is missing"
    return out


def _payloads(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text with spaces appended up to a positive multiple of the block."""
    lengths = np.diff(offsets)
    padded = np.maximum(1, -(-lengths // BLOCK)) * BLOCK
    ends = np.concatenate([[0], np.cumsum(padded)])
    out = np.full(int(ends[-1]), 32, np.uint8)
    for a, b, at in zip(offsets[:-1].tolist(), offsets[1:].tolist(), ends.tolist(), strict=False):
        out[at : at + b - a] = buf[a:b]
    return out, ends


def _encode_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, buf, offsets in text_chunks(batch.column(1), CHUNK_BYTES):
            data, ends = _payloads(buf, offsets)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), pa.array(np.diff(offsets), pa.int64()), pa.array(encode_payloads(data, ends), pa.binary())],
                ["id", "n_bytes", "media"],
            )


def encode(df: DataFrame, id_col: str = "doc_id", data_col: str = "text") -> DataFrame:
    """``id, n_bytes, media``: every value's UTF-8 bytes (null: none), padded with
    spaces up to a positive multiple of 192, as a FLAC stream. One row for each
    input row, repeated and null ids included; other columns are not read.
    """
    src = df.select(df[id_col].cast("long").alias("id"), df[data_col].alias("data"))
    return src.mapInArrow(_encode_batches, "id long, n_bytes long, media binary")


def _block_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, _, buf, offsets in text_chunks(batch.column(1), CHUNK_BYTES):
            ids, rows = batch.column(0), []
            for i, got in enumerate(decode_streams(buf, offsets)):
                key = ids[a + i].as_py()
                if got["error"]:
                    rows.append((key, None, None, None, None, None, got["error"]))
                width = got["pcm"].itemsize if got["pcm"] is not None else 1
                raw = got["pcm"].tobytes() if got["pcm"] is not None else b""
                rows += [
                    (key, j, s, at, size, raw[s * width : (s + size) * width], None) for j, (s, at, size) in enumerate(got["blocks"])
                ]
            if rows:
                names = ["id", "block_no", "first_sample", "byte_offset", "n_samples", "pcm", "error"]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def decode_blocks(df: DataFrame, id_col: str = "id", media_col: str = "media") -> DataFrame:
    """PCM blocks of a FLAC column, one row a frame, with the sample and byte offsets to seek by.

    A null or broken stream gives one row with its ``error`` and no PCM.
    """
    src = df.select(df[id_col].cast("long").alias("id"), df[media_col].alias("media"))
    return src.mapInArrow(
        _block_batches,
        "id long, block_no long, first_sample long, byte_offset long, n_samples long, pcm binary, error string",
    )


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zlib

    for batch in batches:
        for a, b, buf, offsets in text_chunks(batch.column(2), CHUNK_BYTES):
            rows = []
            for i, got in enumerate(decode_streams(buf, offsets)):
                media = buf[offsets[i] : offsets[i + 1]]
                if got["error"]:
                    rows.append((None, None, None, len(media), hashlib.sha256(media).hexdigest(), None, got["error"]))
                    continue
                x = got["pcm"]
                raw = x.view(np.uint8) ^ 128
                times, value = np.bincount(raw, minlength=256), np.arange(256) - 128
                n, total, power = len(x), int(times @ value), int(times @ (value * value))
                flips = int(np.count_nonzero(x[1:] != x[:-1]))
                feature = f"blocks={len(got['blocks'])};mean={total / n:.4f};rms={(power / n) ** 0.5:.4f};moves={flips}"
                rows.append((len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature, None))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), *columns], ["doc_id", "n_bytes", *names]
            )


def digest(encoded: DataFrame) -> DataFrame:
    """Decode the 8-bit streams of ``encode`` and describe payload, stored form and signal.

    ``payload_*`` and ``tail_crc32`` (last 16 bytes) come from the samples read back; a
    broken stream has nulls there and an ``error``.
    """
    return encoded.select("id", "n_bytes", "media").mapInArrow(
        _digest_batches,
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
        "media_sha256 string, feature string, error string",
    )
