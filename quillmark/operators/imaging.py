"""NumPy kernels of sheet reading, one grey image at a time; Spark deals images to tasks.

Images are uint8 arrays of (height, width); points are (x, y) in pixels.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import lru_cache
from itertools import combinations

import numpy as np

#: Factors of the global threshold at which corner marks are sought, strictest first.
STRICTNESS = (0.5, 0.65, 0.8, 1.0)
MIN_AREA = 12
#: Rows that are worked on at a time, so that they stay near the processor.
STRIP = 128
HULL_POINTS = 16


#: A thousand times the share of red, green and blue in the luma.
LUMA = (299, 587, 114)
#: Eight white grey pixels, as one number.
_WHITE = np.uint64(2**64 - 1)


def to_grey(pixels: np.ndarray) -> np.ndarray:
    """Luma of (h, w, 3) RGB, rounded halves to even; grey images as they are."""
    if pixels.ndim == 2:
        return pixels
    if pixels.dtype == np.uint8:
        return grey_of(np.ascontiguousarray(pixels[..., :3]), LUMA)
    return np.rint(pixels[..., :3].astype(np.float64) @ np.array([299.0, 587.0, 114.0]) / 1000).astype(np.uint8)


def grey_of(colours: np.ndarray, weights: tuple[int, int, int]) -> np.ndarray:
    """Luma of bytes (h, w, 3) that stand together in memory, by the weights of the three colours.

    Groups of eight white pixels stay white. Others are weighed in single
    precision: their sums are whole and below 2**24, so exact, and a thousandth
    of them is never so near to a half that its rounding could change.
    """
    flat = colours.reshape(-1)
    out = np.full(colours.shape[0] * colours.shape[1], 255, np.uint8)
    by = np.array(weights, np.float32)

    def luma(part: np.ndarray) -> np.ndarray:
        sums = part.reshape(-1, 3).astype(np.float32) @ by
        sums /= 1000
        return np.rint(sums, out=sums).astype(np.uint8)

    n = out.size // 8
    words = flat[: n * 24].view(np.uint64).reshape(n, 3)
    inked = np.flatnonzero((words[:, 0] & words[:, 1] & words[:, 2]) != _WHITE)
    eights = out[: n * 8].reshape(n, 8)
    for at in range(0, len(inked), 4096):
        some = inked[at : at + 4096]
        eights[some] = luma(words[some].view(np.uint8)).reshape(-1, 8)
    out[n * 8 :] = luma(flat[n * 24 :])
    return out.reshape(colours.shape[:2])


def _set(flat: np.ndarray) -> np.ndarray:
    """Places of the set ones among booleans, quickly if they are few."""
    n = flat.size // 8 * 8
    words = np.flatnonzero(flat[:n].view(np.uint64) != 0)
    if len(words) * 4 > n // 8:
        return np.flatnonzero(flat)
    i, at = np.nonzero(flat[:n].reshape(-1, 8)[words])
    return np.concatenate((words[i] * 8 + at, n + np.flatnonzero(flat[n:])))


def shrink(grey: np.ndarray, max_dim: int) -> np.ndarray:
    """Mean over equal areas, longest side at most ``max_dim``; smaller images as they are."""
    h, w = grey.shape
    scale = min(1.0, max_dim / max(h, w))
    if scale == 1.0:
        return grey
    new_h, new_w = max(1, math.floor(h * scale + 0.5)), max(1, math.floor(w * scale + 0.5))
    sums = integral(grey)
    y, x = np.linspace(0, h, new_h + 1), np.linspace(0, w, new_w + 1)
    j, i = np.minimum(y.astype(int), h - 1), np.minimum(x.astype(int), w - 1)
    rows = sums[j] + (y - j)[:, None] * (sums[j + 1] - sums[j])
    at = rows[:, i] + (x - i) * (rows[:, i + 1] - rows[:, i])
    mean = np.diff(np.diff(at, axis=0), axis=1) * (new_h * new_w) / (h * w)
    return np.rint(mean).clip(0, 255).astype(np.uint8)


def shrunk(pixels: np.ndarray, max_dim: int) -> np.ndarray:
    """``shrink`` of grey, or of each colour."""
    if pixels.ndim == 2:
        return shrink(pixels, max_dim)
    return np.stack([shrink(pixels[:, :, i], max_dim) for i in range(pixels.shape[2])], axis=2)


def otsu(grey: np.ndarray) -> int:
    """Grey level of greatest variance between classes, the first of equal ones; 128 for a constant image."""
    flat = np.ascontiguousarray(grey).ravel()
    # Two pixels at a time, but eight white ones at once.
    words = flat[: flat.size // 8 * 8].view(np.uint64)
    inked = words[words != _WHITE].view(np.uint16)
    pairs = np.bincount(inked, minlength=65_536).reshape(256, 256)
    n = (pairs.sum(axis=0) + pairs.sum(axis=1) + np.bincount(flat[words.size * 8 :], minlength=256)).astype(np.float64)
    n[255] += words.size * 8 - inked.size * 2
    w, s = np.cumsum(n), np.cumsum(n * np.arange(256))
    rest = w[-1] - w
    ok = (w > 0) & (rest > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        between = np.where(ok, w * rest * (s / w - (s[-1] - s) / rest) ** 2, 0.0)
    return int(between.argmax()) if between.max() > 0 else 128


def integral(grey: np.ndarray) -> np.ndarray:
    """(h + 1, w + 1) sums of all above and to the left."""
    out = np.zeros((grey.shape[0] + 1, grey.shape[1] + 1), np.float64)
    np.cumsum(np.cumsum(grey, axis=0, dtype=np.float64), axis=1, out=out[1:, 1:])
    return out


def dark_mask(grey: np.ndarray, divisor: int = 60, bias: float = 30) -> tuple[np.ndarray, int]:
    """Pixels below the global threshold, or well below their neighbourhood's mean and not bright; and the threshold."""
    grey = np.ascontiguousarray(grey)
    h, w = grey.shape
    level = otsu(grey)
    r = max(6, math.floor(min(h, w) / divisor + 0.5))
    mask = grey < level
    # Whole numbers: the sum of a box against its area times the pixel and the bias.
    kind = np.int32 if (2 * r + 1) ** 2 * 255 < 2**31 else np.int64
    narrow = np.uint16 if (2 * r + 1) * 255 < 2**16 else kind
    ys, xs = np.divmod(_set(((grey >= level) & (grey < 200)).ravel()), w)
    rows = np.unique(ys)
    # Runs of rows that hold such pixels, STRIP long at most.
    starts = np.flatnonzero((np.diff(rows, prepend=-h - r) > r) | (np.diff(rows // STRIP, prepend=-1) != 0))
    for top, last in zip(rows[starts].tolist(), rows[np.append(starts[1:], len(rows)) - 1].tolist() if len(rows) else [], strict=True):
        at = slice(*np.searchsorted(ys, (top, last + 1)))
        y, x = ys[at], xs[at]
        left, right = int(x.min()), int(x.max()) + 1
        first, behind, low, high = max(0, top - r), min(h, last + 1 + r), max(0, left - r), min(w, right + r)
        tall = np.zeros((last + 1 - top + 2 * r, right - left + 2 * r), narrow)
        tall[first - top + r : behind - top + r, low - left + r : high - left + r] = grey[first:behind, low:high]
        box = _box_sums(_box_sums(tall, r, 0).astype(kind), r, 1)[y - top, x - left]
        area = (np.minimum(y + r, h - 1) - np.maximum(y - r, 0) + 1) * (np.minimum(x + r, w - 1) - np.maximum(x - r, 0) + 1)
        mask[y, x] = area * (grey[y, x].astype(np.int64) + (int(bias) if float(bias).is_integer() else bias)) < box
    return mask, level


def _box_sums(a: np.ndarray, r: int, axis: int) -> np.ndarray:
    """Sums of each 2 r + 1 neighbours along ``axis``, of runs that double."""
    n = a.shape[axis] - 2 * r
    at = lambda x, first, size: x[first : first + size] if axis == 0 else x[:, first : first + size]
    out, done, length = None, 0, 1
    while True:
        if (2 * r + 1) & length:
            piece = at(a, done, n)
            out = piece.copy() if out is None else np.add(out, piece, out=out)
            done += length
        if done == 2 * r + 1:
            return out
        size = a.shape[axis] - length
        a = at(a, 0, size) + at(a, length, size)
        length *= 2


def opened(mask: np.ndarray) -> np.ndarray:
    """Erosion, then dilation by a plus of five pixels; the outermost pixels are never set."""
    w = mask.shape[1]

    def step(a: np.ndarray, join: Callable) -> np.ndarray:
        out = np.zeros(mask.shape, bool)
        if min(mask.shape) > 2:
            # Rows one after another: neighbours are so many places off, but for those of the outermost pixels.
            flat, inner = a.reshape(-1), out.reshape(-1)[w:-w]
            join(flat[w:-w], flat[w - 1 : -w - 1], out=inner)
            for other in (flat[w + 1 : flat.size - w + 1], flat[: -2 * w], flat[2 * w :]):
                join(inner, other, out=inner)
            out[:, 0] = out[:, -1] = False
        return out

    return step(step(np.ascontiguousarray(mask, bool), np.logical_and), np.logical_or)


def mark_mask(grey: np.ndarray, level: int, factor: float) -> np.ndarray:
    """Only what is as black as printed corner marks, without specks."""
    return opened(grey < math.ceil(max(16, level * factor)))


def components(mask: np.ndarray, min_area: int = MIN_AREA) -> dict[str, np.ndarray]:
    """Groups of pixels that touch by a side: area, box, centroid, aspect and solidity, in raster order of their first pixel.

    Works on the runs of set pixels in each row: runs of neighbouring rows that
    overlap are linked, and labels sink to the least run of each group.
    """
    h, w = mask.shape
    # Rows one after another, with a pixel that is not set behind each: runs begin and end in turns.
    flat = np.zeros(h * (w + 1) + 1, bool)
    flat[1:].reshape(h, w + 1)[:, :w] = mask
    edges = _set(flat[1:] != flat[:-1])
    row, first = np.divmod(edges[::2], w + 1)
    end = edges[1::2] - row * (w + 1)
    n = len(row)
    label = np.arange(n)
    span = w + 2
    lo = np.searchsorted(row * span + end, (row + 1) * span + first, side="right")
    hi = np.searchsorted(row * span + first, (row + 1) * span + end, side="left")
    many = np.maximum(hi - lo, 0)
    u = np.repeat(label, many)
    v = np.arange(len(u)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)
    while len(u):
        a, b = label[u], label[v]
        open_ = a != b
        if not open_.any():
            break
        u, v, a, b = u[open_], v[open_], a[open_], b[open_]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            deeper = label[label]
            if (deeper == label).all():
                break
            label = deeper
    _, group = np.unique(label, return_inverse=True)
    k = int(group.max()) + 1 if n else 0
    size = (end - first).astype(np.float64)
    area = np.bincount(group, size, k)
    sum_x = np.bincount(group, size * (first + end - 1) / 2, k)
    sum_y = np.bincount(group, size * row, k)
    box = [np.full(k, w), np.zeros(k, int), np.full(k, h), np.zeros(k, int)]
    np.minimum.at(box[0], group, first)
    np.maximum.at(box[1], group, end - 1)
    np.minimum.at(box[2], group, row)
    np.maximum.at(box[3], group, row)
    width, height = box[1] - box[0] + 1, box[3] - box[2] + 1
    keep = area >= min_area
    out = {
        "area": area, "min_x": box[0], "max_x": box[1], "min_y": box[2], "max_y": box[3], "cx": sum_x / np.maximum(area, 1), "cy": sum_y / np.maximum(area, 1),
        "aspect": width / height, "solidity": area / (width * height),
    }
    return {name: values[keep] for name, values in out.items()}


def signed_area(p: np.ndarray) -> float:
    q = np.roll(p, -1, axis=0)
    return float((p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]).sum() / 2)


def clockwise(p: np.ndarray) -> np.ndarray:
    """Order of the points around their centre, clockwise as seen in the image."""
    c = p - p.mean(axis=0)
    order = np.argsort(np.arctan2(c[:, 1], c[:, 0]), kind="stable")
    return order[::-1] if signed_area(p[order]) < 0 else order


def convex_hull(p: np.ndarray) -> np.ndarray:
    """Indices of the hull's corners, collinear points left out; fewer than 4 points come back as they are."""
    if len(p) < 4:
        return np.arange(len(p))
    order = np.lexsort((p[:, 1], p[:, 0])).tolist()

    def half(indices: list[int]) -> list[int]:
        chain: list[int] = []
        for i in indices:
            while len(chain) > 1:
                a, b = p[chain[-1]] - p[chain[-2]], p[i] - p[chain[-2]]
                if a[0] * b[1] - a[1] * b[0] > 0:
                    break
                chain.pop()
            chain.append(i)
        return chain[:-1]

    return np.array(half(order) + half(order[::-1]))


def widest_quad(p: np.ndarray, area: np.ndarray) -> np.ndarray | None:
    """Indices, clockwise, of the four hull corners that span the largest area."""
    hull = convex_hull(p)
    if len(hull) > HULL_POINTS:
        hull = hull[np.argsort(-area[hull], kind="stable")[:HULL_POINTS]]
    if len(hull) < 4:
        return None
    best, most = None, 0.0
    for four in combinations(hull.tolist(), 4):
        quad = np.array(four)[clockwise(p[list(four)])]
        size = abs(signed_area(p[quad]))
        if len(hull) == 4 or size > most:
            best, most = quad, size
    return best


#: What a mark is (largest share of the image, least and most aspect, least solidity, least share of
#: the largest mark's area), and of the four chosen the most ratio of areas and error of the page's aspect.
MARK_SHARE, MARK_ASPECT, MARK_SOLIDITY, MARK_LEAST = 0.02, (0.65, 1.55), 0.48, 0.2
MARKS_RATIO, ASPECT_ERROR = 6, 0.45


def corner_marks(found: dict[str, np.ndarray], shape: tuple[int, int], aspect: float, choose: Callable | None = None) -> np.ndarray | None:
    """Indices of the marks at tl, tr, br, bl among components, or None.

    Marks are compact, about square, at most 2 % of the image and no smaller
    than a fifth of the largest. Of the four ways to turn them, those whose sides
    fit the page's ``aspect`` are plausible; ``choose`` picks one by what is
    printed on the page.
    """
    ok = (found["area"] <= shape[0] * shape[1] * MARK_SHARE) & (found["aspect"] >= MARK_ASPECT[0]) & (found["aspect"] <= MARK_ASPECT[1]) & (found["solidity"] >= MARK_SOLIDITY)
    if ok.sum() < 4:
        return None
    ok &= found["area"] >= MARK_LEAST * found["area"][ok].max()
    pool = np.nonzero(ok)[0]
    if len(pool) < 4:
        return None
    p = np.column_stack((found["cx"], found["cy"]))
    quad = widest_quad(p[pool], found["area"][pool])
    if quad is None:
        return None
    quad = pool[quad]
    if found["area"][quad].max() / found["area"][quad].min() > MARKS_RATIO:
        return None
    turned = []
    for r in range(4):
        q = np.roll(quad, -r)
        top, right = np.hypot(*(p[q[0]] - p[q[1]])), np.hypot(*(p[q[1]] - p[q[2]]))
        if right >= 1:
            turned.append((abs(top / right - aspect) / aspect, r, q))
    plausible = [q for error, _, q in sorted(turned, key=lambda t: t[:2]) if error <= ASPECT_ERROR]
    if not plausible:
        return None
    return choose(plausible) if choose and len(plausible) > 1 else plausible[0]


def homography(source: np.ndarray, target: np.ndarray) -> np.ndarray | None:
    """Nine coefficients, the last 1, that take four source points to four target points; None if they don't."""
    a, b = np.zeros((8, 8)), np.zeros(8)
    for i, ((sx, sy), (x, y)) in enumerate(zip(source, target, strict=True)):
        a[2 * i, :3], a[2 * i, 6:] = (sx, sy, 1), (-sx * x, -sy * x)
        a[2 * i + 1, 3:6], a[2 * i + 1, 6:] = (sx, sy, 1), (-sx * y, -sy * y)
        b[2 * i : 2 * i + 2] = x, y
    try:
        h = np.linalg.solve(a, b)
    except np.linalg.LinAlgError:
        return None
    return np.append(h, 1.0) if np.isfinite(h).all() and np.linalg.cond(a) < 1e14 else None


def project(h: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Image of page points; NaN at infinity."""
    d = h[6] * x + h[7] * y + h[8]
    d = np.where(np.abs(d) < 1e-12, np.nan, d)
    return (h[0] * x + h[1] * y + h[2]) / d, (h[3] * x + h[4] * y + h[5]) / d


def disc_shares(mask: np.ndarray, x: np.ndarray, y: np.ndarray, radius: np.ndarray, block: int = 256) -> np.ndarray:
    """Share of dark pixels in a disc around each point, radius 1.5 at least; only pixels inside the image count."""
    h, w = mask.shape
    out = np.zeros(len(x))
    flat = mask.reshape(-1)
    for at in range(0, len(x), block):
        cx, cy = x[at : at + block, None], y[at : at + block, None]
        r = np.maximum(1.5, radius[at : at + block])[:, None]
        reach = np.arange(int(2 * math.ceil(r.max()) + 2))
        px, py = np.floor(cx - r) + reach, np.floor(cy - r) + reach
        # Squares of the distances along each side, of pixels outside the image without end.
        dx, dy = np.where((px >= 0) & (px < w), (px - cx) ** 2, np.inf), np.where((py >= 0) & (py < h), (py - cy) ** 2, np.inf)
        inside = _bits(dx[:, None, :] + dy[:, :, None] <= (r * r)[:, :, None])
        column, row = np.clip(px, 0, w - 1).astype(int), np.clip(py, 0, h - 1).astype(int) * w
        dark = _bits(flat.take(row[:, :, None] + column[:, None, :])) & inside
        total, set_ = (np.bitwise_count(v).sum(axis=1, dtype=np.int64) for v in (inside, dark))
        out[at : at + block] = np.where(total > 0, set_ / np.maximum(total, 1), 0.0)
    return out


def _bits(a: np.ndarray) -> np.ndarray:
    """The booleans of each of the first axis, eight in a byte."""
    return np.packbits(a.reshape(len(a), -1), axis=1)


@lru_cache(maxsize=256)
def _grid(x0: float, y0: float, x1: float, y1: float, steps: int) -> tuple[np.ndarray, np.ndarray]:
    gx, gy = np.meshgrid(np.linspace(x0, x1, steps + 1), np.linspace(y0, y1, steps + 1))
    return gx.ravel(), gy.ravel()


def band_density(mask: np.ndarray, h: np.ndarray, x0: float, y0: float, x1: float, y1: float, steps: int = 28) -> float:
    """Share of dark pixels at a grid of points of a page rectangle."""
    px, py = project(h, *_grid(x0, y0, x1, y1, steps))
    ok = np.isfinite(px) & np.isfinite(py)
    px, py = np.floor(px[ok] + 0.5).astype(int), np.floor(py[ok] + 0.5).astype(int)
    ok = (px >= 0) & (py >= 0) & (px < mask.shape[1]) & (py < mask.shape[0])
    return float(mask[py[ok], px[ok]].mean()) if ok.any() else 0.0


def ring_density(mask: np.ndarray, h: np.ndarray, x_mm: np.ndarray, y_mm: np.ndarray, radius_mm: float) -> float:
    """Mean share of ink in discs as wide as the printed bubbles."""
    x, y = project(h, x_mm, y_mm)
    ex, ey = project(h, x_mm + radius_mm, y_mm)
    ok = np.isfinite(x) & np.isfinite(ex)
    if not ok.any():
        return 0.0
    return float(disc_shares(mask, x[ok], y[ok], np.hypot(ex - x, ey - y)[ok]).mean())
