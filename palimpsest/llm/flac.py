"""Media columns: a FLAC coder and decoder for 8-bit mono samples over batches of columns.

Residuals of all frames of a batch are coded and decoded side by side with numpy: the coder places all Rice codes
by prefix sums of their lengths, the decoder takes one residual of every frame in each step. Constant, verbatim,
fixed (0 to 4) and linear-predictive subframes, any Rice partitioning and escaped partitions are read; frame
headers (CRC-8), frames (CRC-16) and whole streams (MD5) are verified. Every frame has a seek point, so frames are
found without decoding those before them, and PCM blocks carry their sample offsets.

Bytes become samples through a fixed companding table (frequent bytes of text get small amplitudes), named in an
APPLICATION block; it is a permutation, so nothing is lost. Long streams are coded and decoded a group of frames at a
time, so the memory beside a text and its stream is bounded.

Defined results: null text is empty and becomes one block of 64 zero bytes; equal texts give equal bytes; repeated
rows and other columns do not matter; an empty table gives an empty result. A stream whose checksums do not fit
raises ValueError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import flat_utf8, in_arrow, slabs

BLOCK, RATE, PAD = 4096, 8000, 64
#: Samples, and bytes of frames, that are coded or decoded at once (whole frames).
GROUP_SAMPLES, GROUP_BYTES = 512 * 4096, 2 << 20
#: Seek points in a metadata block, whose size has 24 bits.
MOST_POINTS = 900_000
#: No frame that is read is longer.
FRAME_BYTES = 1 << 17
APPLICATION = b"bytA\x01"
#: Companding table, version 1 (fixed values): bytes in the order of falling frequency in prose, the others by number.
_FIRST = b" enatiorshldceuhmpgfbwvyqkjxz.,\nETAIONSRHLDCUMPG\xc3\xa9\xa8\xa0\xaa\xb3\xad\xb6\xbc\xa4\x9f0123456789!?-"
_RANKED = np.array(list(dict.fromkeys([*_FIRST, *range(256)])), np.uint8)
_RANK = np.empty(256, np.int16)
_RANK[_RANKED] = np.arange(256)
TO_SAMPLE = np.where(_RANK & 1, -((_RANK + 1) >> 1), _RANK >> 1).astype(np.int16)
TO_BYTE = np.empty(256, np.uint8)
TO_BYTE[TO_SAMPLE + 128] = np.arange(256)


def _crc_table(poly: int, bits: int) -> np.ndarray:
    top, mask, out = 1 << (bits - 1), (1 << bits) - 1, []
    for b in range(256):
        c = b << (bits - 8)
        for _ in range(8):
            c = ((c << 1) ^ poly if c & top else c << 1) & mask
        out.append(c)
    return np.array(out, np.uint16)


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)
_AT_DISTANCE = [_CRC16]


def crc8(raw: bytes) -> int:
    c = 0
    for b in raw:
        c = int(_CRC8[c ^ b])
    return c


def _distances(n: int) -> np.ndarray:
    """What a byte adds to the CRC-16 when `row` bytes follow it: the CRC is linear, so these are XORed."""
    if len(_AT_DISTANCE[0].reshape(-1, 256)) < n:
        rows = [_CRC16]
        while len(rows) < max(n, 5000):
            last = rows[-1]
            rows.append((last << 8) ^ _CRC16[last >> 8])
        _AT_DISTANCE[0] = np.array(rows, np.uint16)
    return _AT_DISTANCE[0].reshape(-1, 256)


def crc16(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-16 of each data[start:end]; no range is empty."""
    n = ends - starts
    reach = int(n.max(initial=0))
    if reach > 100_000:
        raise ValueError("a frame is longer than the format allows for this depth")
    table = _distances(reach)
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    back = np.repeat(ends - 1 + first, n) - np.arange(n.sum())
    at = np.repeat(starts - first, n) + np.arange(n.sum())
    return np.bitwise_xor.reduceat(table[back - np.repeat(starts, n), data[at]], first)


def _number(n: int) -> bytes:
    """The frame number in the format's extended UTF-8."""
    if n < 0x80:
        return bytes([n])
    tail = []
    size = 1
    while n >= 1 << (6 - size if size < 7 else 0) and size < 7:
        tail.append(0x80 | n & 0x3F)
        n >>= 6
        size += 1
    return bytes([(0xFF << (8 - size)) & 0xFF | n, *reversed(tail)])


def _frames(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Owner, number, first sample (over all) and sample count of each frame."""
    count = -(-lengths // BLOCK)
    owner = np.repeat(np.arange(len(lengths)), count)
    number = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    first = np.repeat(np.cumsum(lengths) - lengths, count) + number * BLOCK
    return owner, number, first, np.minimum(BLOCK, lengths[owner] - number * BLOCK)


def _coded(samples: np.ndarray, lengths: np.ndarray, before: int = 0) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The frames of all runs of samples in a row, their owners, sizes and sample counts; `before` frames went ahead."""
    owner, number, first, n = _frames(lengths)
    number = number + before
    x = samples.astype(np.int32)
    of_frame = np.repeat(np.arange(len(n), dtype=np.int32), n)
    inside = np.arange(len(x), dtype=np.int32) - first.astype(np.int32)[of_frame]
    prev, prev2 = np.concatenate([[0], x[:-1]]).astype(np.int32), np.concatenate([[0, 0], x[:-2]])[: len(x)].astype(np.int32)
    prev[first], prev2[first] = 0, 0
    prev2[(first + 1)[n > 1]] = 0
    total = lambda v: np.add.reduceat(v, first)  # noqa: E731  sums of a frame fit into 32 bits at this depth
    r0, r1, r2 = (total(x * y).astype(np.float64) for y in (x, prev, prev2))
    det = r0 * r0 - r1 * r1
    with np.errstate(divide="ignore", invalid="ignore"):
        a1 = np.where(det > 0, r1 * (r0 - r2) / det, 0)
        a2 = np.where(det > 0, (r0 * r2 - r1 * r1) / det, 0)
    a1, a2 = (np.clip(np.nan_to_num(a) * 512, -2048, 2047).astype(np.int32) for a in (a1, a2))
    residuals = x, x - prev, x - 2 * prev + prev2, x - ((a1[of_frame] * prev + a2[of_frame] * prev2) >> 9)
    size_of = np.array([total(np.abs(r)) for r in residuals])
    # predictor by the least sum of amplitudes; kind: 0 verbatim, 1 + order fixed, 9 linear prediction of order 2
    pick = np.where((size_of[3] * 20 < size_of[:3].min(axis=0) * 17) & (n > 2), 3, size_of[:3].argmin(axis=0))
    order = np.minimum(np.array([0, 1, 2, 2])[pick], n)
    residual = residuals[0].copy()
    for i in np.unique(pick[pick > 0]):
        np.copyto(residual, residuals[i], where=(pick == i)[of_frame])
    code = (residual << 1) ^ (residual >> 31)
    code[inside < order.astype(np.int32)[of_frame]] = 0
    k_of = np.clip(np.floor(np.log2(np.maximum(total(code) / np.maximum(n - order, 1) * 0.6931, 1))), 0, 14).astype(np.int32)
    cost = total(code >> k_of[of_frame]) + (n - order) * (1 + k_of) + 18 + 8 * order + 33 * (pick == 3)
    best = np.minimum(cost, 8 * n + 8)
    kind = np.where(cost < 8 * n + 8, np.array([1, 2, 3, 9])[pick], 0)
    constant = (np.minimum.reduceat(x, first) == np.maximum.reduceat(x, first)) & (n > 1)
    kind, best = np.where(constant, -1, kind), np.where(constant, 16, best)
    order = np.where(kind > 0, order, 0)

    header = [b"\xff\xf8\x70\x02" + _number(int(i)) + struct.pack(">H", m - 1) for i, m in zip(number, n)]
    header = [h + bytes([crc8(h)]) for h in header]
    h_len = np.array([len(h) for h in header], np.int64)
    size = h_len + (best + 7) // 8 + 2
    at = np.cumsum(size) - size
    bits = np.zeros(8 * int(size.sum()), np.uint8)
    rice = kind > 0
    lead = 8 + 8 * order + 10 + np.where(kind == 9, 33, 0)
    coded = np.flatnonzero((inside >= np.where(rice, order, BLOCK + 1).astype(np.int32)[of_frame]))
    k, u = k_of[of_frame[coded]], code[coded]
    quotient = u >> k
    width = quotient + 1 + k
    per = np.where(rice, n - order, 0)
    run = np.cumsum(width, dtype=np.int64) - width
    begin = np.cumsum(per) - per
    base = 8 * (at + h_len) + lead - np.where(per > 0, run[np.minimum(begin, max(len(run) - 1, 0))] if len(run) else 0, 0)
    stop = np.repeat(base, per) + run + quotient
    bits[stop] = 1
    for width in np.unique(k):
        own = k == width
        place, rest = stop[own], u[own]
        for j in range(width):
            bits[place + (1 + j)] = (rest >> (width - 1 - j)) & 1
    out = np.packbits(bits)
    for f, (kd, o, h, p) in enumerate(zip(kind, order, header, at)):
        out[p : p + len(h)] = np.frombuffer(h, np.uint8)
        p, s, m = int(p) + len(h), int(first[f]), int(n[f])
        if kd == -1:
            out[p : p + 2] = 0, x[s] & 0xFF
        elif kd == 0:
            out[p] = 0b10
            out[p + 1 : p + 1 + m] = x[s : s + m] & 0xFF
        else:
            lead_bits = f"{(32 + 1 if kd == 9 else 8 + o) << 1:08b}" + "".join(f"{int(v) & 0xFF:08b}" for v in x[s : s + o])
            if kd == 9:
                lead_bits += f"{11:04b}{9:05b}{int(a1[f]) & 0xFFF:012b}{int(a2[f]) & 0xFFF:012b}"
            lead_bits += f"000000{int(k_of[f]):04b}"
            lead_bits += "0" * (-len(lead_bits) % 8)
            out[p : p + len(lead_bits) // 8] |= np.frombuffer(int(lead_bits, 2).to_bytes(len(lead_bits) // 8, "big"), np.uint8)
    ends = at + size
    sums = crc16(out, at, ends - 2)
    out[ends - 2], out[ends - 1] = sums >> 8, sums & 0xFF

    return out.tobytes(), owner, size, n


def encode(samples: np.ndarray, lengths: np.ndarray) -> list[bytes]:
    """One FLAC stream for each run of `lengths` 8-bit samples (-128..127); no run is empty."""
    streams, end = [], np.cumsum(lengths)
    d = 0
    while d < len(lengths):
        lo = int(end[d] - lengths[d])
        to = max(int(np.searchsorted(end, lo + GROUP_SAMPLES, "right")), d + 1)
        if to == d + 1:  # one run, perhaps a long one
            steps = range(lo, int(end[d]), GROUP_SAMPLES)
            parts = [_coded(samples[a : min(a + GROUP_SAMPLES, int(end[d]))], np.array([min(GROUP_SAMPLES, int(end[d]) - a)]), (a - lo) // BLOCK) for a in steps]
            streams.append(_stream(samples[lo : int(end[d])], b"".join(p[0] for p in parts), *[np.concatenate([p[i] for p in parts]) for i in (2, 3)]))
        else:
            raw, owner, size, n = _coded(samples[lo : int(end[to - 1])], lengths[d:to])
            of, at = np.searchsorted(owner, np.arange(to - d + 1)), np.append(0, np.cumsum(size))
            for i in range(to - d):
                a, b = of[i], of[i + 1]
                streams.append(_stream(samples[int(end[d + i] - lengths[d + i]) : int(end[d + i])], raw[at[a] : at[b]], size[a:b], n[a:b]))
        d = to
    return streams


def _stream(samples: np.ndarray, frames: bytes, size: np.ndarray, n: np.ndarray) -> bytes:
    """Head with a seek point for each frame, and the frames."""
    info = struct.pack(">HH", BLOCK, BLOCK) + int(size.min()).to_bytes(3, "big") + int(size.max()).to_bytes(3, "big")
    info += ((RATE << 44) | (7 << 36) | len(samples)).to_bytes(8, "big") + hashlib.md5(samples.astype(np.int8).tobytes()).digest()
    points = [struct.pack(">QQH", *p) for p in zip((np.cumsum(n) - n).tolist(), (np.cumsum(size) - size).tolist(), n.tolist())]
    tables = [b"".join(points[i : i + MOST_POINTS]) for i in range(0, len(points), MOST_POINTS)]
    blocks = ((0, info), *[(3, t) for t in tables], (2, APPLICATION))
    head = b"fLaC" + b"".join(bytes([t | (0x80 if t == 2 else 0)]) + len(v).to_bytes(3, "big") + v for t, v in blocks)
    return head + frames


class _Bits:
    """Big-endian bit fields at many places of one byte array, and the next 1 bit from any place on."""

    def __init__(self, data: np.ndarray):
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        wide = padded.astype(np.int64)
        n = len(data) + 4
        self.words = (wide[:n] << 32) | (wide[1 : n + 1] << 24) | (wide[2 : n + 2] << 16) | (wide[3 : n + 3] << 8) | wide[4 : n + 4] if len(data) else np.zeros(5, np.int64)
        ones = np.flatnonzero(np.unpackbits(padded))
        if len(padded) < 2**28:
            ones = ones.astype(np.int32)
        #: For each bit the place of the next 1 bit, itself included; behind the last one its own place.
        self.next_one = np.concatenate([np.repeat(ones, np.diff(ones, prepend=-1)), np.full(8 * len(padded) - (int(ones[-1]) + 1 if len(ones) else 0), ones[-1] if len(ones) else 0, ones.dtype)])

    def get(self, at: np.ndarray, width) -> np.ndarray:
        """Fields of up to 32 bits."""
        return (self.words[at >> 3] >> (40 - (at & 7) - width)) & ((1 << width) - 1)

    def signed(self, at: np.ndarray, width) -> np.ndarray:
        v = self.get(at, width)
        return v - ((v >> (width - 1)) << width)


def _residuals(bits: _Bits, at: np.ndarray, n: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Residuals [frame, sample] behind the warm-up of frames sorted by falling n, and where each frame's bits end."""
    at = at.astype(np.int64).copy()
    method, parts = bits.get(at, 2), bits.get(at + 2, 4)
    if (method > 1).any():
        raise ValueError("a residual coding method is reserved")
    at += 6
    wide = np.where(method == 1, 5, 4)
    share = n >> parts
    left = np.zeros(len(n), np.int64)
    todo = n - order
    k, raw = np.zeros(len(n), np.int64), np.zeros(len(n), bool)
    out = np.zeros((int(n.max(initial=0)), len(n)), np.int32)  # zigzag codes, a sample of all frames side by side
    flat, next_one, words = out.reshape(-1), bits.next_one, bits.words
    first = np.ones(len(n), bool)
    live = np.arange(len(n))[todo > 0]
    col = order.copy()
    any_raw = False
    while len(live):
        new = live[left[live] == 0]
        if len(new):
            k[new] = bits.get(at[new], wide[new])
            at[new] += wide[new]
            raw[new] = k[new] == (1 << wide[new]) - 1
            esc = new[raw[new]]
            if len(esc):
                k[esc] = bits.get(at[esc], 5)
                at[esc] += 5
            any_raw = bool(raw.any())
            left[new] = share[new] - np.where(first[new], order[new], 0)
            first[new] = False
        steps = int(left[live].min())
        p, kk, c = at[live], k[live], col[live]
        plain = np.ones(len(live), bool) if not any_raw else ~raw[live]
        mask, reach, cell, row = (1 << kk) - 1, 40 - kk, live + c * len(n), len(n)
        for j in range(0, steps * row, row):
            if any_raw:
                width = np.where(plain, 1, kk)
                given = np.where(kk > 0, bits.signed(p, np.maximum(width, 1)), 0)
                stop = np.where(plain, bits.next_one[p], p)
                u = ((stop - p) << kk) | bits.get(stop + 1, kk)
                flat[cell + j] = np.where(plain, u, (given << 1) ^ (given >> 63))
                p = np.where(plain, stop + 1 + kk, p + kk)
            else:
                rest = next_one[p] + 1
                flat[cell + j] = ((rest - p - 1) << kk) | ((words[rest >> 3] >> (reach - (rest & 7))) & mask)
                p = rest + kk
        at[live], col[live] = p, c + steps
        left[live] -= steps
        todo[live] -= steps
        live = live[todo[live] > 0]
    out = np.ascontiguousarray(out.T)
    return (out >> 1) ^ -(out & 1), at


def _decode_frames(data: np.ndarray, starts: np.ndarray, depth: int = 8) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Samples, numbers and ends of the frames that begin at `starts` in data."""
    bits = _Bits(data)
    m = len(starts)
    n, number, sub = np.zeros(m, np.int64), np.zeros(m, np.int64), np.zeros(m, np.int64)
    raw = data.tobytes()
    for i, s in enumerate(starts):
        s = int(s)
        if raw[s : s + 2] not in (b"\xff\xf8", b"\xff\xf9"):
            raise ValueError("no frame begins here")
        code, p, lead = raw[s + 2] >> 4, s + 4, raw[s + 4]
        more = 0
        while lead & (0x80 >> more):
            more += 1
        value = lead & (0x7F >> more if more else 0x7F)
        for b in raw[p + 1 : p + max(more, 1)]:
            value = value << 6 | b & 0x3F
        p += max(more, 1)
        if code == 6:
            size, p = raw[p] + 1, p + 1
        elif code == 7:
            size, p = int.from_bytes(raw[p : p + 2], "big") + 1, p + 2
        else:
            size = 192 if code == 1 else 576 << (code - 2) if code <= 5 else 256 << (code - 8)
        if raw[s + 3] >> 4 or (raw[s + 3] >> 1) & 7 not in (0, 1) or raw[s + 2] & 15 > 11:
            raise ValueError("only 8-bit mono frames at a rate of the stream's head are read")
        if crc8(raw[s:p]) != raw[p]:
            raise ValueError("a frame header's checksum is wrong")
        n[i], number[i], sub[i] = size, value, p + 1
    at = sub * 8
    kind = bits.get(at + 1, 6)
    if bits.get(at, 1).any() or bits.get(at + 7, 1).any():
        raise ValueError("a subframe has wasted bits or a wrong head")
    at = at + 8
    out: list[np.ndarray] = [np.zeros(0, np.int32)] * m
    end = np.zeros(m, np.int64)
    for i in np.flatnonzero(kind == 0):
        out[i] = np.full(n[i], bits.signed(at[i : i + 1], 8)[0], np.int32)
        end[i] = at[i] + 8
    for i in np.flatnonzero(kind == 1):
        p = int(at[i]) // 8
        out[i] = data[p : p + n[i]].astype(np.int8).astype(np.int32)
        end[i] = at[i] + 8 * n[i]
    fixed, lpc = (kind >= 8) & (kind <= 12), kind >= 32
    if not (fixed | lpc | (kind <= 1)).all():
        raise ValueError("a subframe type is reserved")
    own = np.flatnonzero(fixed | lpc)
    own = own[np.argsort(-n[own], kind="stable")]
    if len(own):
        order = np.where(fixed[own], kind[own] - 8, (kind[own] & 31) + 1)
        warm = [[int(bits.signed(at[i : i + 1] + 8 * j, 8)[0]) for j in range(o)] for i, o in zip(own, order)]
        begin = at[own] + 8 * order
        coefs: dict[int, tuple[int, list[int]]] = {}
        for r, i in enumerate(own):
            if lpc[i]:
                p = begin[r : r + 1]
                precision, shift = int(bits.get(p, 4)[0]) + 1, int(bits.signed(p + 4, 5)[0])
                coefs[r] = shift, [int(bits.signed(p + 9 + precision * j, precision)[0]) for j in range(order[r])]
                begin[r] += 9 + precision * order[r]
        got, ends = _residuals(bits, begin, n[own], order)
        for r, w in enumerate(warm):
            got[r, : len(w)] = w
        end[own] = ends
        restored = _restore_lpc(got, n[own], coefs) if coefs else got
        for r, (i, o) in enumerate(zip(own, order)):
            row = restored[r, : n[i]]
            if fixed[i]:
                for level in range(int(o), 0, -1):  # sums of differences; each level starts from the warm-up's differences
                    lead = np.diff(np.array(warm[r][:level], np.int64), level - 1)[-1:]
                    row[level - 1] = lead[0]
                    row[level - 1 :] = np.cumsum(row[level - 1 :])
            out[i] = row
    stop = (end + 7) // 8
    if len(starts):
        sums = crc16(data, starts, stop)
        if (sums != ((data[stop].astype(np.uint16) << 8) | data[stop + 1])).any():
            raise ValueError("a frame's checksum is wrong")
    return out, number, stop + 2


def _restore_lpc(got: np.ndarray, n: np.ndarray, coefs: dict[int, tuple[int, list[int]]]) -> np.ndarray:
    """Adds the predictions, one sample of all linear-predictive frames of one order in each step."""
    out = got.astype(np.int64)
    for order in {len(c) for _, c in coefs.values()}:
        rows = np.array([r for r, (_, c) in coefs.items() if len(c) == order])
        weights = np.array([coefs[r][1][::-1] for r in rows], np.int64)
        shift = np.array([coefs[r][0] for r in rows], np.int64)
        part, size = out[rows], n[rows]
        for t in range(order, int(size.max())):
            live = size > t
            guess = (part[:, t - order : t] * weights).sum(axis=1) >> shift
            part[:, t] += np.where(live, guess, 0)
        out[rows] = part
    return out.astype(np.int32)


def decode(streams: list[bytes]) -> list[list[tuple[int, np.ndarray]]]:
    """PCM blocks (sample offset, samples) of each stream; every checksum is verified."""
    heads, body, at = [], [], 0
    for s in streams:
        if s[:4] != b"fLaC":
            raise ValueError("not a FLAC stream")
        p, info, points = 4, b"", []
        while True:
            last, kind, size = s[p] & 0x80, s[p] & 0x7F, int.from_bytes(s[p + 1 : p + 4], "big")
            block = s[p + 4 : p + 4 + size]
            info = block if kind == 0 else info
            if kind == 3:
                points += [q for q in struct.iter_unpack(">QQH", block) if q[0] != 2**64 - 1]
            p += 4 + size
            if last:
                break
        packed = int.from_bytes(info[10:18], "big")
        if (packed >> 36) & 0xFF != 7:
            raise ValueError("only 8-bit mono streams are read")
        heads.append((packed & (1 << 36) - 1, info[18:34], points, at, at + len(s) - p))
        body.append(memoryview(s)[p:])
        at += len(s) - p
    data = np.frombuffer(b"".join(body), np.uint8)
    blocks: list[list[tuple[int, np.ndarray]]] = [[] for _ in streams]
    stop = [h[4] for h in heads]
    complete = [sum(q[2] for q in h[2]) == h[0] for h in heads]
    todo = sorted((lo + q[1], d, q[0]) for d, (_, _, points, lo, _) in enumerate(heads) if complete[d] for q in points)
    starts = np.array([t[0] for t in todo], np.int64)
    i = 0
    while i < len(todo):  # groups of frames whose places are known
        j = max(int(np.searchsorted(starts, starts[i] + GROUP_BYTES)), i + 1)
        got, _, _ = _decode_frames(data[starts[i] : starts[j] if j < len(todo) else len(data)], starts[i:j] - starts[i])
        for (_, d, offset), x in zip(todo[i:j], got):
            blocks[d].append((offset, x.astype(np.int8)))
        i = j
    for d, h in enumerate(heads):  # without seek points each frame says where the next one begins
        at, offset = h[3], 0
        while not complete[d] and offset < h[0]:
            (x,), _, (end,) = _decode_frames(data[at : min(at + FRAME_BYTES, stop[d])], np.zeros(1, np.int64))
            blocks[d].append((offset, x.astype(np.int8)))
            at, offset = at + int(end), offset + len(x)
    for found, (total, md5, *_) in zip(blocks, heads):
        found.sort(key=lambda b: b[0])
        sums = hashlib.md5()
        for _, x in found:
            sums.update(x.tobytes())
        if sum(len(x) for _, x in found) != total or md5 != bytes(16) and sums.digest() != md5:
            raise ValueError("a stream's samples do not have its digest")
    return blocks


def to_media(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, media): each text's UTF-8 bytes, padded with zeros to a positive multiple of 64, as FLAC."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slabs(batches, "t"):
            raw, off = flat_utf8(batch.column("t"))
            n = np.diff(off)
            full = np.maximum(-(-n // PAD), 1) * PAD
            start = np.cumsum(full) - full
            padded = np.zeros(int(full.sum()), np.uint8)
            if len(n) == 1:  # perhaps a long one
                padded[: len(raw)] = raw
            else:
                padded[np.repeat(start - off[:-1], n) + np.arange(len(raw))] = raw
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(n, pa.int64()), pa.array(encode(TO_SAMPLE[padded], full), pa.binary())], names=[key, "n_bytes", "media"])

    kind = docs.schema[key].dataType.simpleString()
    return in_arrow(docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")), run, f"`{key}` {kind}, n_bytes long, media binary")


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes], list[list[tuple[int, np.ndarray]]]]]:
    for batch in slabs(batches, "media"):
        media = [m or b"" for m in batch.column("media").to_pylist()]
        yield batch, media, decode(media)


def pcm_blocks(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, sample_offset, n_samples, pcm): decoded signed 8-bit blocks, each to be found by its sample offset."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, found in _decoded(batches):
            rows = [(i, o, len(x), x.tobytes()) for i, blocks in enumerate(found) for o, x in blocks]
            i, o, n, pcm = zip(*rows) if rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([batch.column("k").take(pa.array(i, pa.int64())), pa.array(o, pa.int64()), pa.array(n, pa.int64()), pa.array(pcm, pa.binary())], names=[key, "sample_offset", "n_samples", "pcm"])

    kind = media.schema[key].dataType.simpleString()
    return in_arrow(media.select(F.col(key).alias("k"), "media"), run, f"`{key}` {kind}, sample_offset long, n_samples long, pcm binary")


def _measured(media: bytes, blocks: list[np.ndarray]) -> tuple:
    """The feature columns of one stream, block by block."""
    sums, tail, before = hashlib.sha256(), b"", None
    n = peak = total = energy = flips = 0
    for x in blocks:
        payload = TO_BYTE[x.astype(np.int16) + 128].tobytes()
        sums.update(payload)
        tail = (tail + payload)[-PAD:]
        wide = x.astype(np.int64)
        low = wide < 0
        flips += int(np.count_nonzero(low[1:] != low[:-1])) + int(before is not None and len(x) and before != low[0])
        before = low[-1]
        n, peak, total, energy = n + len(x), max(peak, int(np.abs(wide).max())), total + int(wide.sum()), energy + int((wide * wide).sum())
    return n, sums.hexdigest(), zlib.crc32(tail), len(media), hashlib.sha256(media).hexdigest(), f"{n}:{peak}:{total}:{energy}:{flips}"


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def features(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """Digests of the payload and of the stored form, and `samples:peak:sum:energy:sign changes` of the samples."""
    names = [key, "n_bytes", *[c.split()[0] for c in FEATURES.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, stored, found in _decoded(batches):
            cols: list[list] = [[] for _ in range(6)]
            for m, blocks in zip(stored, found):
                row = _measured(m, [b for _, b in blocks])
                for c, v in zip(cols, row):
                    c.append(v)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("n_bytes"), *[pa.array(c, t) for c, t in zip(cols, kinds)]], names=names)

    kind = media.schema[key].dataType.simpleString()
    return in_arrow(media.select(F.col(key).alias("k"), "n_bytes", "media"), run, f"`{key}` {kind}, n_bytes long, {FEATURES}")
