"""Baseline JPEG files from pixels, for stored pages and their thumbnails.

Colour images keep all three components at full size. Blocks are transformed,
quantised and turned into symbols for the whole image at once; the Huffman codes
are those of the image's own symbols, so no table of codes is needed.
"""

from __future__ import annotations

import heapq
import struct

import numpy as np

#: Quantisation steps of luminance and chrominance at quality 50, in rows.
LUMINANCE = (
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
)
CHROMINANCE = (
    17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99,
    *[99] * 32,
)

#: Places of a block along its diagonals, which turn at the edges.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
#: The cosine transform of eight values.
COSINES = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(1 / 8) if u == 0 else 0.5) for x in range(8)] for u in range(8)])

MOST_LENGTH = 16


def steps(table: tuple[int, ...], quality: int) -> np.ndarray:
    """Quantisation steps at a quality from 1 to 100."""
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return np.clip((np.array(table) * scale + 50) // 100, 1, 255)


def components_of(pixels: np.ndarray) -> list[np.ndarray]:
    """Grey as it is; red, green and blue as luminance and two differences."""
    if pixels.ndim == 2:
        return [pixels.astype(np.float64)]
    r, g, b = (pixels[:, :, i].astype(np.float64) for i in range(3))
    y = 0.299 * r + 0.587 * g + 0.114 * b
    return [y, 128 + (b - y) / 1.772, 128 + (r - y) / 1.402]


def blocks_of(plane: np.ndarray) -> np.ndarray:
    """(n, 8, 8) blocks in rows, the last pixels repeated to fill them."""
    h, w = plane.shape
    full = np.pad(plane, ((0, -h % 8), (0, -w % 8)), mode="edge")
    return full.reshape(full.shape[0] // 8, 8, -1, 8).swapaxes(1, 2).reshape(-1, 8, 8)


def code_lengths(counts: dict[int, int]) -> list[tuple[int, int]]:
    """(symbol, bits) of codes of 16 bits at most, shortest first; the code of all ones stays free."""
    heap = [(n, i, (s,)) for i, (s, n) in enumerate(sorted(counts.items()))] + [(0, -1, (-1,))]
    depth = dict.fromkeys([*counts, -1], 0)
    heapq.heapify(heap)
    order = len(heap)
    while len(heap) > 1:
        (n, _, a), (m, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        for s in a + b:
            depth[s] += 1
        heapq.heappush(heap, (n + m, order, a + b))
        order += 1
    held = np.bincount(list(depth.values()), minlength=MOST_LENGTH + 1)
    # Two codes that are too long become one a bit shorter, and a shorter one makes room for the other.
    for n in range(len(held) - 1, MOST_LENGTH, -1):
        while held[n]:
            shorter = next(k for k in range(n - 2, 0, -1) if held[k])
            held[n] -= 2
            held[n - 1] += 1
            held[shorter] -= 1
            held[shorter + 1] += 2
    lengths = np.repeat(np.arange(len(held)), held)
    by_count = sorted(counts, key=lambda s: (-counts[s], s))
    return list(zip(by_count, lengths[: len(by_count)].tolist(), strict=True))


def _codes(lengths: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Code and bits by symbol."""
    code, bits = np.zeros(256, np.int64), np.zeros(256, np.int64)
    now = last = 0
    for s, n in lengths:
        now <<= n - last
        code[s], bits[s], last = now, n, n
        now += 1
    return code, bits


def _size(v: np.ndarray) -> np.ndarray:
    """Bits of a value's magnitude."""
    return np.where(v == 0, 0, np.floor(np.log2(np.maximum(np.abs(v), 1))).astype(np.int64) + 1)


def _symbols(zz: np.ndarray, n_components: int) -> tuple[np.ndarray, ...]:
    """(kind, symbol, value, bits) of all blocks in order; kind is 2 * table + (0 for the first coefficient, 1 for others)."""
    n = len(zz)
    component = np.arange(n) % n_components
    first = zz[:, 0]
    change = first - np.where(np.arange(n) < n_components, 0, np.roll(first, n_components))
    block, at = np.nonzero(zz[:, 1:])
    at = at + 1
    value = zz[block, at]
    run = at - np.where(np.diff(block, prepend=-1) == 0, np.roll(at, 1), 0) - 1
    skips = np.repeat(np.arange(len(at)), run // 16)
    last = np.zeros(n, np.int64)
    np.maximum.at(last, block, at)
    ends = np.flatnonzero(last < 63)
    zero = np.zeros
    place = np.concatenate((np.arange(n) * 1024, block * 1024 + at * 8 + 7, block[skips] * 1024 + at[skips] * 8, ends * 1024 + 1023))
    order = np.argsort(place, kind="stable")
    join = lambda *parts: np.concatenate(parts)[order]
    table = np.where(component > 0, 2, 0)
    kind = join(table, table[block] + 1, table[block[skips]] + 1, table[ends] + 1)
    symbol = join(_size(change), (run % 16) * 16 + _size(value), np.full(len(skips), 0xF0), zero(len(ends), np.int64))
    values = join(change, value, zero(len(skips), np.int64), zero(len(ends), np.int64))
    bits = join(_size(change), _size(value), zero(len(skips), np.int64), zero(len(ends), np.int64))
    return kind, symbol, values, bits


def _packed(values: np.ndarray, bits: np.ndarray) -> bytes:
    """Bits of all values one after another, filled up with ones; a byte of ones is followed by one of zeros."""
    ends = np.cumsum(bits)
    owner = np.repeat(np.arange(len(bits)), bits)
    shift = ends[owner] - 1 - np.arange(ends[-1] if len(ends) else 0)
    stream = (values[owner] >> shift & 1).astype(np.uint8)
    stream = np.concatenate((stream, np.ones(-len(stream) % 8, np.uint8)))
    return np.packbits(stream).tobytes().replace(b"\xff", b"\xff\x00")


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def encode(pixels: np.ndarray, quality: int) -> bytes:
    """A JPEG file of grey (h, w) or red, green and blue (h, w, 3) bytes; at least a pixel and at most 65,535 a side."""
    h, w = pixels.shape[:2]
    if not (0 < h < 65536 and 0 < w < 65536):
        raise ValueError("image sides must be from 1 to 65,535")
    planes = components_of(pixels)
    tables = [steps(LUMINANCE, quality), steps(CHROMINANCE, quality)][: min(len(planes), 2)]
    quantised = [np.rint(COSINES @ (blocks_of(p) - 128) @ COSINES.T / tables[min(i, 1)].reshape(8, 8)).astype(np.int64) for i, p in enumerate(planes)]
    zz = np.stack(quantised, axis=1).reshape(-1, 64)[:, ZIGZAG]
    kind, symbol, value, extra = _symbols(zz, len(planes))
    out = [b"\xff\xd8", _segment(0xE0, b"JFIF\x00\x01\x01\x00\x00\x01\x00\x01\x00\x00")]
    out += [_segment(0xDB, bytes([i]) + bytes(t[ZIGZAG].tolist())) for i, t in enumerate(tables)]
    parts = b"".join(bytes([i + 1, 0x11, min(i, 1)]) for i in range(len(planes)))
    out.append(_segment(0xC0, struct.pack(">BHHB", 8, h, w, len(planes)) + parts))
    code, bits = np.zeros(len(kind), np.int64), np.zeros(len(kind), np.int64)
    for k in range(2 * len(tables)):
        mine = kind == k
        found, n = np.unique(symbol[mine], return_counts=True)
        lengths = code_lengths(dict(zip(found.tolist(), n.tolist(), strict=True)))
        held = np.bincount([b for _, b in lengths], minlength=MOST_LENGTH + 1)[1:]
        out.append(_segment(0xC4, bytes([(k % 2) * 16 + k // 2]) + bytes(held.tolist()) + bytes(s for s, _ in lengths)))
        by_symbol = _codes(lengths)
        code[mine], bits[mine] = by_symbol[0][symbol[mine]], by_symbol[1][symbol[mine]]
    scan = b"".join(bytes([i + 1, min(i, 1) * 17]) for i in range(len(planes)))
    out.append(_segment(0xDA, bytes([len(planes)]) + scan + b"\x00\x3f\x00"))
    # A negative value is written as what is left to the next power of two.
    coded = np.where(value < 0, value + (1 << extra) - 1, value)
    return b"".join([*out, _packed(code << extra | coded, bits + extra), b"\xff\xd9"])
