"""Array kernels on planes of a tile or a cell, in numpy: what pixels need that rows can't give."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np

from ..config import Config


@cache
def _linear() -> np.ndarray:
    v = np.arange(256) / 255
    return np.where(v > 0.04045, ((v + 0.055) / 1.055) ** 2.4, v / 12.92)


def lab(rgb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """L, a, b of sRGB bytes, in single precision."""
    m = np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]])
    t = _linear()[rgb] @ m.T / np.array([0.95047, 1.0, 1.08883])
    f = np.where(t > 0.008856, np.cbrt(t), 7.787 * t + 16 / 116)
    return tuple(p.astype(np.float32) for p in (116 * f[..., 1] - 16, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])))


@lru_cache(maxsize=64)
def disk(radius: int) -> np.ndarray:
    y, x = np.ogrid[-radius : radius + 1, -radius : radius + 1]
    return x * x + y * y <= radius * radius


def _shifts(footprint: np.ndarray) -> np.ndarray:
    return np.argwhere(footprint) - np.array(footprint.shape) // 2


def dilate(mask: np.ndarray, footprint: np.ndarray) -> np.ndarray:
    """mask: [..., y, x], each plane for itself. With margins as wide as the footprint a shift of the planes is one of the flat array."""
    shifts = _shifts(footprint)
    ry, rx = np.abs(shifts).max(0, initial=0)
    h, w = mask.shape[-2:]
    wide = np.zeros((*mask.shape[:-2], h + 2 * ry, w + 2 * rx), mask.dtype)
    inner = (..., slice(ry, ry + h), slice(rx, rx + w))
    wide[inner] = mask
    flat, out = wide.reshape(-1), np.zeros(wide.size, mask.dtype)
    for by in shifts @ (w + 2 * rx, 1):
        out[max(0, by) : len(out) + min(0, by)] |= flat[max(0, -by) : len(out) - max(0, by)]
    return out.reshape(wide.shape)[inner]


def erode(mask: np.ndarray, footprint: np.ndarray) -> np.ndarray:
    """Pixels outside the image count as set."""
    return ~dilate(~mask, footprint[::-1, ::-1])


def close(mask: np.ndarray, footprint: np.ndarray) -> np.ndarray:
    pad = max(footprint.shape)
    wide = np.pad(mask, pad)
    return erode(dilate(wide, footprint), footprint)[pad:-pad, pad:-pad]


def _swept(low: np.ndarray, top: np.ndarray) -> None:
    """Each row raised to the row before, one column to either side included, but not above its own limit. Row, plane, column; the outer columns are -inf."""
    for r in range(1, len(low)):
        before = low[r - 1]
        up = np.maximum(before[:, :-2], before[:, 2:])
        np.maximum(up, before[:, 1:-1], out=up)
        np.maximum(up, low[r, :, 1:-1], out=up)
        np.minimum(up, top[r, :, 1:-1], out=low[r, :, 1:-1])


def h_maxima(img: np.ndarray, h: float) -> np.ndarray:
    """Peaks that rise by h at least over the way to a higher one. img: [..., y, x], each plane for itself; what is -inf lies outside.

    The image lowered by h is raised below the image by sweeps down, up, right and left until a round changes nothing.
    """
    planes = img.astype(float).reshape(-1, *img.shape[-2:])
    out = np.zeros(planes.shape, bool)
    live = np.flatnonzero(planes.max((1, 2)) - np.where(planes > -np.inf, planes, np.inf).min((1, 2)) >= h)
    wide = lambda a: np.pad(a, ((0, 0), (0, 0), (1, 1)), constant_values=-np.inf)
    top = planes[live]
    low = top - h
    while len(live):
        before, rows, limit = low, wide(low.transpose(1, 0, 2)), wide(top.transpose(1, 0, 2))
        _swept(rows, limit)
        _swept(rows[::-1], limit[::-1])
        columns, limit = wide(rows[:, :, 1:-1].transpose(2, 1, 0)), wide(top.transpose(2, 0, 1))
        _swept(columns, limit)
        _swept(columns[::-1], limit[::-1])
        low = columns[:, :, 1:-1].transpose(1, 2, 0)
        moved = (low != before).any((1, 2))
        done = ~moved
        with np.errstate(invalid="ignore"):  # -inf - -inf
            out[live[done]] = top[done] - low[done] >= h * (1 - 1e-7)
        live, top, low = live[moved], top[moved], np.ascontiguousarray(low[moved])
    return out.reshape(img.shape)


def label8(mask: np.ndarray) -> np.ndarray:
    """8-connected components of [..., y, x], numbered by their first pixel, through all planes.

    Runs of pixels in a row are linked with the runs they touch in the next one, and linked runs take the least number.
    """
    mask = mask.astype(bool)
    if not mask.any():
        return np.zeros(mask.shape, np.int64)
    h, w = mask.shape[-2:]
    flat = np.zeros((mask.size // (h * w), h + 1, w + 1), np.int8)  # a column and a row part rows and planes
    flat[:, :h, :w] = mask.reshape(-1, h, w)
    step = np.diff(flat.ravel(), prepend=0)
    starts, ends = np.flatnonzero(step > 0), np.flatnonzero(step < 0)
    first = np.searchsorted(ends, starts + w + 1)
    n = np.maximum(np.searchsorted(starts, ends + w + 1, "right") - first, 0)
    one = np.repeat(np.arange(len(starts)), n)
    other = np.arange(n.sum()) - np.repeat(n.cumsum() - n, n) + np.repeat(first, n)
    mark = np.arange(len(starts))
    while True:
        p, q = mark[one], mark[other]
        unlike = p != q
        if not unlike.any():
            break
        p, q = p[unlike], q[unlike]
        np.minimum.at(mark, np.maximum(p, q), np.minimum(p, q))
        while not np.array_equal(hop := mark[mark], mark):
            mark = hop
    out = np.zeros(mask.shape, np.int64)
    out[mask] = np.repeat(np.unique(mark, return_inverse=True)[1] + 1, ends - starts)
    return out


def perimeter(mask: np.ndarray) -> float:
    """Length of the border by the pattern of each border pixel's border neighbours. The weights are fixed values."""
    m = np.pad(mask, 2)
    inner = m[1:-1, 1:-1] & m[:-2, 1:-1] & m[2:, 1:-1] & m[1:-1, :-2] & m[1:-1, 2:]
    b = (m[1:-1, 1:-1] & ~inner).astype(int)
    p = np.pad(b, 1)
    n4 = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:]
    n8 = p[:-2, :-2] + p[:-2, 2:] + p[2:, :-2] + p[2:, 2:]
    code = np.where(b > 0, b + 2 * n4 + 10 * n8, 0)
    weights = {5: 1, 7: 1, 15: 1, 17: 1, 25: 1, 27: 1, 21: math.sqrt(2), 33: math.sqrt(2), 13: (1 + math.sqrt(2)) / 2, 23: (1 + math.sqrt(2)) / 2}
    return float(sum(w * int((code == k).sum()) for k, w in weights.items()))


def solidity(mask: np.ndarray) -> float:
    """Area over the pixels of the convex hull of all pixel edges."""
    ys, xs = np.nonzero(mask)
    pts = sorted({(float(x + dx), float(y + dy)) for y, x in zip(ys, xs, strict=True) for dx, dy in ((0.5, 0), (-0.5, 0), (0, 0.5), (0, -0.5))})

    def chain(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
        out: list[tuple[float, float]] = []
        for p in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    hull = chain(pts) + chain(pts[::-1])
    gy, gx = np.mgrid[0 : mask.shape[0], 0 : mask.shape[1]]
    inside = np.ones(mask.shape, bool)
    for (x0, y0), (x1, y1) in zip(hull, hull[1:] + hull[:1], strict=True):
        inside &= (x1 - x0) * (gy - y0) - (y1 - y0) * (gx - x0) >= -1e-9
    return float(mask.sum() / inside.sum())


#: Bitmaps of up to this many pixels are remembered with what follows from them alone; most dots are small and alike.
_SMALL = 1 << 10


def _form(bits: np.ndarray) -> tuple[float, float]:
    return (_small_form if bits.size <= _SMALL else _small_form.__wrapped__)(bits.shape, bits.tobytes())


@lru_cache(maxsize=1 << 13)
def _small_form(shape: tuple[int, int], raw: bytes) -> tuple[float, float]:
    bits = np.frombuffer(raw, bool).reshape(shape)
    return perimeter(bits), solidity(bits)


@lru_cache(maxsize=1 << 12)
def _small_ring(shape: tuple[int, int], raw: bytes, gap: int, width: int) -> np.ndarray:
    own = np.pad(np.frombuffer(raw, bool).reshape(shape), max(gap + width, 1))
    return dilate(own, disk(max(gap + width, 1))) & ~dilate(own, disk(max(gap, 0)))


def ring_mean(img: np.ndarray, y0: int, x0: int, bits: np.ndarray, gap: int, width: int, roi: np.ndarray) -> float | None:
    """Mean over the ring around a blob, within the region; None if it's empty."""
    pad = max(gap + width, 1)
    t, l = max(0, y0 - pad), max(0, x0 - pad)  # noqa: E741
    b, r = min(img.shape[0], y0 + bits.shape[0] + pad), min(img.shape[1], x0 + bits.shape[1] + pad)
    ring = (_small_ring if bits.size <= _SMALL else _small_ring.__wrapped__)(bits.shape, bits.tobytes(), gap, width)
    dy, dx = y0 - pad, x0 - pad
    values = img[t:b, l:r][ring[t - dy : b - dy, l - dx : r - dx] & roi[t:b, l:r]]
    return float(values.mean()) if len(values) else None


def _quantile(ordered: np.ndarray, begin: np.ndarray, size: np.ndarray, q: float) -> np.ndarray:
    """np.quantile of each group of single-precision values, ascending within it."""
    at = (size - 1).astype(np.float32) * np.float32(q)
    low = np.floor(at).astype(int)
    t = at - low.astype(np.float32)
    a, b = ordered[begin + low], ordered[begin + np.minimum(low + 1, size - 1)]
    return np.where(t >= 0.5, b - (b - a) * (1 - t), a + (b - a) * t)


#: Columns of a candidate row; the gates are Spark expressions over them (operators.dots).
CANDIDATE = "dot_type string, blob int, y double, x double, area int, radius double, circularity double, solidity double, mean_l double, mean_a double, mean_b double, p20_l double, median_chroma double, p90_chroma double, chroma double, ring double, score double"


#: Pixels of a stack of patches.
STACK_PIXELS = 1 << 16


def candidates(rgb: np.ndarray, nucleus: np.ndarray, cfg: Config) -> list[tuple]:
    """Candidate dots of both kinds in the patch of a cell (K13-K15), before any gate. rgb: H x W x 3; nucleus: the cell's own nuclei."""
    return candidates_of([(rgb, nucleus)], cfg)[0]


def candidates_of(patches: list[tuple[np.ndarray, np.ndarray]], cfg: Config) -> list[list[tuple]]:
    """candidates() of many patches. Those of like sizes are stacked, so that a step of numpy serves many."""
    out: list[list[tuple]] = [[] for _ in patches]
    like: dict[tuple[int, int], list[int]] = {}
    for i, (_, nucleus) in enumerate(patches):
        if nucleus.any():
            h, w = nucleus.shape
            like.setdefault((-(-h // 8) * 8, -(-w // 8) * 8), []).append(i)
    for (h, w), members in like.items():
        step = max(1, STACK_PIXELS // (h * w))
        for k in range(0, len(members), step):
            part = members[k : k + step]
            rgb, own, real = np.zeros((len(part), h, w, 3), np.uint8), np.zeros((len(part), h, w), bool), np.zeros((len(part), h, w), bool)
            for j, i in enumerate(part):
                box = (j, slice(patches[i][1].shape[0]), slice(patches[i][1].shape[1]))
                rgb[box], own[box] = patches[i]
                real[box] = True
            for j, row in _stacked(rgb, own, real, cfg):
                out[part[j]].append(row)
    return out


def _stacked(rgb: np.ndarray, own: np.ndarray, real: np.ndarray, cfg: Config) -> Iterator[tuple[int, tuple]]:
    """Patch number and candidate. real: the patches' pixels, without what fills them up to one size. Colours matter in the nuclei only."""
    planes = [np.zeros(own.shape, np.float32) for _ in range(3)]
    for plane, values in zip(planes, lab(rgb[own]), strict=True):
        plane[own] = values
    L, a, b = planes
    roi = own & ~(L > cfg.background_l)
    red = np.where(roi, a, np.float32(0))
    dark = np.where(roi, L, np.float32(100))
    peaks = h_maxima(np.where(real, red, -np.inf), cfg.red_h) & roi
    pits = h_maxima(np.where(real, -dark, -np.inf), cfg.black_h) & roi
    regions = (
        ("cep17", dilate(peaks, disk(cfg.seed_dilate)) & (red >= cfg.red_a_min) & roi, a, cfg.red_ring_gap, cfg.red_ring_width),
        ("her2", dilate(pits, disk(cfg.black_seed_dilate)) & (dark <= cfg.black_l_max) & roi, L, cfg.black_ring_gap, cfg.black_ring_width),
    )
    for kind, region, img, gap, width in regions:
        marks = label8(region)[region]
        if not len(marks):
            continue
        order = np.argsort(marks, kind="stable")
        marks = marks[order]
        j, ys, xs = (c[order] for c in np.nonzero(region))
        size = np.bincount(marks)[1:]
        begin = size.cumsum() - size
        y0, x0, y1, x1 = np.minimum.reduceat(ys, begin), np.minimum.reduceat(xs, begin), np.maximum.reduceat(ys, begin) + 1, np.maximum.reduceat(xs, begin) + 1
        values = [p[j, ys, xs] for p in (L, a, b)]
        chroma = np.hypot(values[1], values[2])
        sorted_l, sorted_chroma = (v[np.lexsort((v, marks))] for v in (values[0], chroma))
        p20, p90 = _quantile(sorted_l, begin, size, 0.2), _quantile(sorted_chroma, begin, size, 0.9)
        middle = (sorted_chroma[begin + (size - 1) // 2] + sorted_chroma[begin + size // 2]) / np.float32(2)
        cy, cx = np.add.reduceat(ys, begin) / size, np.add.reduceat(xs, begin) / size
        last, number = -1, 0
        for k in range(len(size)):
            patch, s = int(j[begin[k]]), slice(int(begin[k]), int(begin[k] + size[k]))
            number, last = number + 1 if patch == last else 0, patch
            top, left, area = int(y0[k]), int(x0[k]), int(size[k])
            bits = np.zeros((int(y1[k]) - top, int(x1[k]) - left), bool)
            bits[ys[s] - top, xs[s] - left] = True
            p, solid = _form(bits)
            ml, ma, mb = (float(np.add.reduce(v[s]) / np.float32(area)) for v in values)
            ring = ring_mean(img[patch], top, left, bits, gap, width, roi[patch])
            yield patch, (kind, number, float(cy[k]), float(cx[k]), area, math.sqrt(area / math.pi), 4 * math.pi * area / p**2 if p > 0 else 0.0, solid, ml, ma, mb, float(p20[k]), float(middle[k]), float(p90[k]), math.hypot(ma, mb), ring, ma if kind == "cep17" else -ml)


def drop_fragments(mask: np.ndarray, least: int = 550) -> np.ndarray:
    """Without 8-connected components of fewer pixels (P20)."""
    marks = label8(mask)
    size = np.bincount(marks.ravel())
    size[0] = 0
    return (size >= least)[marks]


@lru_cache(maxsize=64)
def ellipse(size: int) -> np.ndarray:
    """The filled ellipse in a square of this odd size: half widths by row, rounded to even."""
    r = size // 2
    half = [int(np.rint(r * math.sqrt(1 - (dy / r) ** 2))) if r else 0 for dy in range(-r, r + 1)]
    return np.abs(np.arange(-r, r + 1))[None] <= np.array(half)[:, None]


def clean_core(mask: np.ndarray, kernel: int = 7, least: int = 550) -> np.ndarray:
    """Closed by an ellipse (what lies outside the image counts in neither step), fragments of fewer pixels dropped (K2)."""
    m = mask.astype(bool)
    if kernel > 1:
        m = erode(dilate(m, ellipse(kernel)), ellipse(kernel))
    return drop_fragments(m, least) if least > 0 else m


def fill_enclosed(mask: np.ndarray, kernel: int = 3, least: int = 50) -> np.ndarray:
    """Closed, holes filled that don't reach the border, opened, small parts dropped."""
    m = close(mask.astype(bool), disk(kernel // 2))
    outside = label8(~m)
    border = np.unique(np.concatenate((outside[0], outside[-1], outside[:, 0], outside[:, -1])))
    m = m | ~np.isin(outside, border[border > 0])
    m = dilate(erode(m, disk(kernel // 2)), disk(kernel // 2))
    return drop_fragments(m, least)


def expand_labels(labels: np.ndarray, distance: float) -> np.ndarray:
    """Labels grown by a Euclidean distance, each pixel to its nearest label, the lower of equally near ones.

    Two passes of a distance transform that carry the label: first the nearest label within each row, then the nearest
    of the rows in reach. Work grows with the distance, not with its square.
    """
    if distance <= 0 or not labels.any():
        return labels
    r, (h, w) = int(math.floor(distance)), labels.shape
    far, col, row = np.int64(1) << 40, np.arange(w), np.arange(h)[:, None]
    left = np.maximum.accumulate(np.where(labels > 0, col, -far), axis=1)
    right = np.minimum.accumulate(np.where(labels > 0, col, far)[:, ::-1], axis=1)[:, ::-1]
    to_left, to_right = col - left, right - col
    own_left, own_right = labels[row, np.clip(left, 0, w - 1)], labels[row, np.clip(right, 0, w - 1)]
    near = np.where(to_left < to_right, own_left, np.where(to_right < to_left, own_right, np.minimum(own_left, own_right)))
    gap = np.minimum(to_left, to_right)
    gap = np.where(gap <= r, gap * gap, far)
    best, out = gap.copy(), near.copy()
    for d in range(1, min(r, h - 1) + 1):
        for src, to in ((slice(None, -d), slice(d, None)), (slice(d, None), slice(None, -d))):
            offer, label = gap[src] + d * d, near[src]
            nearer = (offer < best[to]) | ((offer == best[to]) & (label < out[to]))
            best[to] = np.where(nearer, offer, best[to])
            out[to] = np.where(nearer, label, out[to])
    return np.where(np.sqrt(best) <= distance, out, 0).astype(labels.dtype)


def enlarged(labels: np.ndarray, factor: float) -> np.ndarray:
    """Labels grown so that the typical one has `factor` times its area (K11): the distance comes from the median radius (A7). A factor of 1 or less changes nothing."""
    area = np.bincount(labels.ravel())[1:]
    area = area[area > 0]
    if factor <= 1 or not len(area):
        return labels
    return expand_labels(labels, float(np.median(np.sqrt(area / math.pi))) * (math.sqrt(factor) - 1))


def renumbered(labels: np.ndarray) -> np.ndarray:
    """Ids 1..n in the order of the old ones."""
    ids = np.unique(labels)
    return np.searchsorted(ids[ids > 0], labels, "right").astype(labels.dtype)


def without_edges(labels: np.ndarray, top: bool, bottom: bool, left: bool, right: bool) -> np.ndarray:
    """Labels that touch none of the given sides, renumbered (P6); with all sides the plain clearing of borders."""
    sides = [side for side, on in ((labels[0], top), (labels[-1], bottom), (labels[:, 0], left), (labels[:, -1], right)) if on]
    return renumbered(np.where(np.isin(labels, np.unique(np.concatenate(sides))), 0, labels) if sides else labels)


def blurred(mask: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian blur in single precision, four sigmas wide, edges mirrored, held within [0, 1] (K3)."""
    out = mask.astype(np.float32)
    if sigma <= 0:
        return out
    r = int(4 * sigma + 0.5)
    weight = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    weight /= weight.sum()
    for axis in (0, 1):
        pad = [(r, r) if k == axis else (0, 0) for k in (0, 1)]
        wide = np.pad(out, pad, mode="symmetric").astype(float)
        size = out.shape[axis]
        out = sum(w * wide.take(range(k, k + size), axis) for k, w in enumerate(weight)).astype(np.float32)
    return np.clip(out, 0, 1)


def masked(rgb: np.ndarray, core: np.ndarray, fill: int, sigma: float = 0.0) -> np.ndarray:
    """The image inside the mask, the fill outside, mixed where the mask is blurred (K3 K4)."""
    if core.shape != rgb.shape[:2]:
        raise ValueError("mask and image differ in size")
    m = blurred(core > 0, sigma)[..., None]
    return (rgb.astype(np.float32) * m + np.float32(fill) * (1 - m)).astype(np.uint8)


def fused(dish: np.ndarray, ihc: np.ndarray, alpha: float) -> np.ndarray:
    """dish * (1 - alpha) + ihc * alpha, cut towards zero (K5)."""
    if not 0 <= alpha <= 1:
        raise ValueError("alpha must be in [0, 1]")
    if dish.shape != ihc.shape:
        raise ValueError("the images differ in size")
    return np.clip(dish.astype(np.float32) * (1 - alpha) + ihc.astype(np.float32) * alpha, 0, 255).astype(np.uint8)


def window_starts(length: int, tile: int, overlap: int) -> list[int]:
    """Starts of windows along an axis (K7)."""
    last = max(length - tile, 0)
    return sorted({*range(0, last + 1, tile - overlap), last})


def detach(labels: np.ndarray) -> list[tuple[int, int, int, np.ndarray]]:
    """Area, top, left and bitmap of each label."""
    out = []
    for k in np.unique(labels[labels > 0]):
        ys, xs = np.nonzero(labels == k)
        bits = labels[ys.min() : ys.max() + 1, xs.min() : xs.max() + 1] == k
        out.append((len(ys), int(ys.min()), int(xs.min()), bits))
    return out


def suppress(instances: list[tuple[int, int, int, np.ndarray]], iomin: float = 0.5, grid: int = 256) -> list[int]:
    """Places of instances kept: by falling area, unless one kept before covers `iomin` of the smaller (K10 G4). Only instances of common grid squares are compared."""
    keep: list[int] = []
    squares: dict[tuple[int, int], list[int]] = {}
    for i in sorted(range(len(instances)), key=lambda i: -instances[i][0]):
        area, y, x, bits = instances[i]
        own = [(p, q) for p in range(y // grid, (y + bits.shape[0] - 1) // grid + 1) for q in range(x // grid, (x + bits.shape[1] - 1) // grid + 1)]
        for j in {k for square in own for k in squares.get(square, ())}:
            other, oy, ox, obits = instances[j]
            t, l = max(y, oy), max(x, ox)  # noqa: E741
            b, r = min(y + bits.shape[0], oy + obits.shape[0]), min(x + bits.shape[1], ox + obits.shape[1])
            n = (bits[t - y : b - y, l - x : r - x] & obits[t - oy : b - oy, l - ox : r - ox]).sum() if t < b and l < r else 0
            if n and n >= iomin * min(area, other):
                break
        else:
            keep.append(i)
            for square in own:
                squares.setdefault(square, []).append(i)
    return keep


def segment_windows(image: np.ndarray, predict, tile: int = 1024, overlap: int = 256, iomin: float = 0.5) -> np.ndarray:
    """Labels of an image from a predictor over windows (K9): detached, deduplicated, painted on free pixels in the order kept."""
    found = []
    for y in window_starts(image.shape[0], tile, overlap):
        for x in window_starts(image.shape[1], tile, overlap):
            found += [(n, t + y, l + x, bits) for n, t, l, bits in detach(predict(image[y : y + tile, x : x + tile]))]
    out = np.zeros(image.shape[:2], np.int32)
    for k, i in enumerate(suppress(found, iomin), 1):
        _, y, x, bits = found[i]
        part = out[y : y + bits.shape[0], x : x + bits.shape[1]]
        part[bits & (part == 0)] = k
    return out


def whole_core():
    """A predictor that takes every pixel for tissue."""
    return lambda images: np.ones(images.shape[:3], np.uint8)


def stain_core(least_density: float = 0.15):
    """A stand-in for a trained mask predictor (K1): pixels whose density of the brown stain reaches a threshold (K17). Takes and gives several windows at once."""
    from .pixels import STAINS

    rows = np.array(STAINS)
    inverse = np.linalg.inv(rows / np.linalg.norm(rows, axis=1, keepdims=True))

    def predict(images: np.ndarray) -> np.ndarray:
        density = -np.log(np.maximum(images.astype(float), 1) / 255) @ inverse
        return (density[..., 1] >= least_density).astype(np.uint8)

    return predict


def threshold_segmenter(least_density: float = 0.15, least: int = 20):
    """A stand-in for a trained segmenter: components of dark pixels (F1). Not a claim of equal segmentation."""

    def predict(image: np.ndarray) -> np.ndarray:
        od = -np.log((image.astype(float).mean(-1) + 1) / 256)
        return label8(drop_fragments(od > least_density, least)).astype(np.int32)

    return predict
