"""Vectorised word and shingle hashes of a batch of texts, in numpy over the UTF-8 bytes."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
WIDTH = 5


def _splitmix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer."""
    with np.errstate(over="ignore"):
        return _splitmix(np.asarray(x, U) + U(0x9E3779B97F4A7C15))


KEEP = np.array([(1 << 8 * i) - 1 for i in range(9)], U)
_PLACE = [int(x) | 1 for x in mix(np.arange(64, dtype=U) + U(901))]


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array without nulls."""
    texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, off, data = texts.buffers()
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    o = np.frombuffer(off, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None and o[-1] > o[0] else np.zeros(0, np.uint8)
    return d, o - o[0]


def _in_word() -> np.ndarray:
    t = np.zeros(256, bool)
    t[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
    return t


IN_WORD = _in_word()


#: Words over this many bytes are hashed one by one.
_LONG = 128


def words(data: np.ndarray, off: np.ndarray, in_word: np.ndarray = IN_WORD) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (runs of word bytes) of all texts, and each text's offsets into them."""
    h, starts, _ = spans(data, off, in_word)
    return h, np.searchsorted(starts, off).astype(np.int64)


def spans(data: np.ndarray, off: np.ndarray, in_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words' hashes, and where they start and end."""
    n = len(data)
    if n == 0:
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    is_w = in_word[data]
    first, last = is_w.copy(), is_w.copy()
    np.greater(is_w[1:], is_w[:-1], out=first[1:])
    np.greater(is_w[:-1], is_w[1:], out=last[:-1])
    head, tail = off[:-1][off[:-1] < n], off[1:][off[1:] > 0] - 1
    first[head], last[tail] = is_w[head], is_w[tail]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    size = ends - starts
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = data
    eight = np.ndarray((n + 1,), "<u8", padded, 0, (1,))  # the eight bytes from each place on
    part = eight[starts] & KEEP[np.minimum(size, 8)]
    h = mix(part ^ (size.astype(U) << U(56)))
    live = np.flatnonzero((size > 8) & (size <= _LONG))
    at = 8
    while len(live):
        h[live] = mix(h[live] ^ (eight[starts[live] + at] & KEEP[np.minimum(size[live] - at, 8)]))
        at += 8
        live = live[size[live] > at]
    for i in np.flatnonzero(size > _LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return h, starts, ends


def shingles(texts: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in ascending order, how often each occurs, and the texts' offsets.

    Words are runs of letters and digits in lower case; a text of fewer words than width has the one shingle
    of them all, a text of punctuation alone the one of its bytes, and an empty text none.
    """
    low = pc.utf8_lower(pc.fill_null(texts, ""))
    data, off = raw(low)
    w, wo = words(data, off)
    n = np.diff(wo)
    with np.errstate(over="ignore"):
        acc = np.zeros(max(0, len(w) - width + 1), U)
        for j in range(width):
            acc += w[j : j + len(acc)] * U(_PLACE[j])
    count = np.where(n >= width, n - width + 1, np.where(np.diff(off) > 0, 1, 0))
    so = np.concatenate(([0], np.cumsum(count)))
    out = np.empty(so[-1], U)
    full = n >= width
    if full.any():
        for i in np.flatnonzero(full).tolist():
            out[so[i] : so[i + 1]] = acc[wo[i] : wo[i + 1] - width + 1]
    with np.errstate(over="ignore"):
        for i in np.flatnonzero(~full & (count > 0)).tolist():
            a, b = int(wo[i]), int(wo[i + 1])
            if b > a:
                out[so[i]] = sum(int(w[a + j]) * _PLACE[j] for j in range(b - a)) + (b - a) * 0x2545F4914F6CDD1D & 0xFFFFFFFFFFFFFFFF
            else:
                whole, _ = words(data[off[i] : off[i + 1]], np.array([0, off[i + 1] - off[i]]), np.ones(256, bool))
                out[so[i]] = whole[0] ^ U(0x5851F42D4C957F2D)
    out = mix(out)
    for a, b in zip(so[:-1].tolist(), so[1:].tolist()):
        out[a:b].sort()
    return distinct(out, so)


def distinct(values: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values and counts of segments that are in order."""
    if len(values) == 0:
        return values, np.zeros(0, np.int64), off
    new = np.empty(len(values), bool)
    new[0] = True
    np.not_equal(values[1:], values[:-1], out=new[1:])
    inner = off[(off > 0) & (off < len(values))]
    new[inner] = True
    at = np.flatnonzero(new)
    counts = np.diff(np.concatenate((at, [len(values)])))
    return values[at], counts, np.searchsorted(at, off).astype(np.int64)
