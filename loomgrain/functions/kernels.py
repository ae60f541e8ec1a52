"""Array work on images; numpy only, called inside Spark tasks.

Blurs, ridges, medians, morphology, adaptive equalisation and non-local means also take stacks (..., height, width) of images of one size, and
give what they give for each image alone, bit by bit.
"""

from __future__ import annotations

import math

import numpy as np


def blur_weights(sigma: float) -> np.ndarray:
    r = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return w / w.sum()


def along(img: np.ndarray, w: np.ndarray, axis: int, border: str) -> np.ndarray:
    """Correlation with a symmetric kernel along one axis; border: symmetric, edge or constant (zero)."""
    r = len(w) // 2
    pad = [(0, 0)] * img.ndim
    pad[axis] = (r, r)
    big = np.pad(img, pad, mode=border)
    n = img.shape[axis]
    out = np.zeros(img.shape)
    for k, x in enumerate(w):
        out += x * big.take(np.arange(k, k + n), axis)
    return out


def gaussian(img: np.ndarray, sigma: float | None, border: str = "symmetric") -> np.ndarray:
    if not sigma:
        return img.astype(float)
    w = blur_weights(sigma)
    return along(along(img.astype(float), w, -2, border), w, -1, border)


def sobel_tensor(img: np.ndarray, sigma: float) -> np.ndarray:
    """(jxx, jxy, jyy) of Sobel derivatives with zero border, blurred."""
    smooth, diff = np.array([1.0, 2.0, 1.0]), np.array([-1.0, 0.0, 1.0])
    gy = along(along(img, diff, 0, "constant"), smooth, 1, "constant") / 4
    gx = along(along(img, smooth, 0, "constant"), diff, 1, "constant") / 4
    return np.stack([gaussian(p, sigma, "constant") for p in (gx * gx, gx * gy, gy * gy)])


def tubeness(img: np.ndarray, sigma_max: int = 3) -> np.ndarray:
    """Largest positive principal curvature of the negated image over blurs of 1..sigma_max, scaled by sigma squared."""
    best = np.zeros(img.shape)
    for sigma in range(1, sigma_max + 1):
        soft = gaussian(-img, sigma, "edge")
        gy, gx = np.gradient(soft, axis=(-2, -1))
        yy, yx = np.gradient(gy, axis=(-2, -1))
        xx = np.gradient(gx, axis=-1)
        top = (yy + xx) / 2 + np.sqrt(((yy - xx) / 2) ** 2 + yx**2)
        best = np.maximum(best, np.where(top > 0, top, 0) * sigma**2)
    return best


def li_threshold(img: np.ndarray) -> float:
    """Minimum cross-entropy threshold by its fixed-point iteration."""
    v = img[np.isfinite(img)].ravel()
    if not len(v) or v.min() == v.max():
        return float(v[0]) if len(v) else 0.0
    low = v.min()
    v = v - low
    step = np.diff(np.unique(v))
    tolerance = step.min() / 2
    t = v.mean()
    for _ in range(1000):
        above = v > t
        if above.all() or not above.any():
            break
        front, back = v[above].mean(), v[~above].mean()
        if back == 0:
            break
        new = (back - front) / (math.log(back) - math.log(front))
        if abs(new - t) <= tolerance:
            t = new
            break
        t = new
    return float(t + low)


def isodata_threshold(img: np.ndarray, bins: int = 256) -> float:
    """The smallest histogram level that is midway between the means of what is below and above it."""
    lo, hi = float(img.min()), float(img.max())
    return lo if lo == hi else isodata_of(np.histogram(img, bins, (lo, hi))[0], lo, hi)


def isodata_of(n: np.ndarray, lo: float, hi: float) -> float:
    """isodata_threshold() from the counts of equal bins between the extremes."""
    edges = np.linspace(lo, hi, len(n) + 1)
    mid = (edges[:-1] + edges[1:]) / 2
    width = mid[1] - mid[0]
    below = np.cumsum(n)
    above = below[-1] - below
    mass = np.cumsum(n * mid)
    ok = (below[:-1] > 0) & (above[:-1] > 0)
    low = mass[:-1] / np.maximum(below[:-1], 1)
    high = (mass[-1] - mass[:-1]) / np.maximum(above[:-1], 1)
    gap = (low + high) / 2 - mid[:-1]
    hit = np.flatnonzero(ok & (gap >= 0) & (gap < width))
    return float(mid[hit[0]]) if len(hit) else float(mid[0])


def label(mask: np.ndarray, diagonal: bool = True) -> np.ndarray:
    """Connected parts numbered from 1 in row-major order; runs of a row are joined with those of the row above."""
    h, w = mask.shape
    parent: list[int] = []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    reach = 1 if diagonal else 0
    runs: list[tuple[int, int, int]] = []
    above: list[int] = []
    for y in range(h):
        row = np.concatenate([[False], mask[y].astype(bool), [False]])
        edge = np.flatnonzero(row[1:] != row[:-1])
        now = []
        k = 0
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            i = len(parent)
            parent.append(i)
            runs.append((y, a, b))
            now.append(i)
            while k < len(above) and runs[above[k]][2] + reach <= a:
                k += 1
            j = k
            while j < len(above) and runs[above[j]][1] < b + reach:
                p, q = root(above[j]), root(i)
                parent[max(p, q)] = min(p, q)
                j += 1
        above = now
    out = np.zeros(mask.shape, np.int64)
    number: dict[int, int] = {}
    for i, (y, a, b) in enumerate(runs):
        out[y, a:b] = number.setdefault(root(i), len(number) + 1)
    return out


def filled_area(ys: np.ndarray, xs: np.ndarray) -> int:
    """Pixels of one part and of what it encloses."""
    shape = np.zeros((ys.max() - ys.min() + 3, xs.max() - xs.min() + 3), bool)
    shape[ys - ys.min() + 1, xs - xs.min() + 1] = True
    around = label(~shape)  # the background beyond the frame is the first part
    return int((around != around[0, 0]).sum())


def hysteresis_limits(img: np.ndarray, alpha: float = 1.0) -> tuple[float, float]:
    """The low and the high threshold of hysteresis()."""
    low = min(alpha * img.mean(), li_threshold(img))
    high = isodata_threshold(img)
    return float(min(low, high)), high


def hysteresis(img: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    """4-connected parts above the low threshold that hold a value above the high one."""
    low, high = hysteresis_limits(img, alpha)
    parts = label(img > low, diagonal=False)
    strong = np.unique(parts[(img > high) & (parts > 0)])
    return np.isin(parts, strong) & (parts > 0)


def drop_small(mask: np.ndarray, size: int, diagonal: bool = False) -> np.ndarray:
    parts = label(mask, diagonal)
    n = np.bincount(parts.ravel())
    return mask & (n[parts] >= size)


def fill_small(mask: np.ndarray, size: int = 64) -> np.ndarray:
    return ~drop_small(~mask, size)


def fill_enclosed(mask: np.ndarray) -> np.ndarray:
    parts = label(~mask, diagonal=False)
    frame = np.concatenate([parts[0], parts[-1], parts[:, 0], parts[:, -1]])
    return mask | ~np.isin(parts, np.unique(frame[frame > 0])) & (parts > 0)


def dilate(mask: np.ndarray, times: int = 1) -> np.ndarray:
    out = mask.astype(bool)
    for _ in range(times):
        p = np.pad(out, [(0, 0)] * (out.ndim - 2) + [(1, 1)] * 2)
        out = p[..., 1:-1, 1:-1] | p[..., :-2, 1:-1] | p[..., 2:, 1:-1] | p[..., 1:-1, :-2] | p[..., 1:-1, 2:]
    return out


def erode(mask: np.ndarray, times: int = 1) -> np.ndarray:
    out = mask.astype(bool)
    for _ in range(times):
        p = np.pad(out, [(0, 0)] * (out.ndim - 2) + [(1, 1)] * 2)
        out = p[..., 1:-1, 1:-1] & p[..., :-2, 1:-1] & p[..., 2:, 1:-1] & p[..., 1:-1, :-2] & p[..., 1:-1, 2:]
    return out


def line(a: tuple[int, int], b: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Pixels from a to b by the integer line rule; at a tie the shorter axis steps away from a."""
    dy, dx = b[0] - a[0], b[1] - a[1]
    n = max(abs(dy), abs(dx))
    t = np.arange(n + 1)
    gone = [np.sign(d) * ((2 * abs(d) * t + n) // (2 * max(n, 1))) for d in (dy, dx)]
    return a[0] + gone[0], a[1] + gone[1]


def network_mask(lines: list, height: int, width: int, times: int, sigma: float | None, area: int) -> tuple[np.ndarray, np.ndarray]:
    """(ys, xs) of lines drawn, widened, blurred to what isn't zero, and small holes filled, within an image.

    Only the box that can hold the result is made; what lies outside of it belongs to the background that surrounds it.
    """
    if not lines:
        return np.zeros(0, int), np.zeros(0, int)
    drawn = [line(a, b) for a, b in lines]
    ys, xs = np.concatenate([d[0] for d in drawn]), np.concatenate([d[1] for d in drawn])
    inside = (ys >= 0) & (xs >= 0) & (ys < height) & (xs < width)
    ys, xs = ys[inside], xs[inside]
    if not len(ys):
        return ys, xs
    blur = int(4 * sigma + 0.5) if sigma else 0
    more = times + blur + 1
    y0, x0 = max(0, ys.min() - more), max(0, xs.min() - more)
    m = np.zeros((min(height, ys.max() + more + 1) - y0, min(width, xs.max() + more + 1) - x0), bool)
    m[ys - y0, xs - x0] = True
    m = dilate(m, times)
    for axis in (0, 1):
        big = np.pad(m, [(blur, blur) if k == axis else (0, 0) for k in (0, 1)])
        m = np.logical_or.reduce([big.take(np.arange(k, k + m.shape[axis]), axis) for k in range(2 * blur + 1)])
    holes = label(~m, diagonal=False)
    n = np.bincount(holes.ravel())
    # background on a side of the box that isn't the image's goes on outside, together with all of that
    cut = [holes[0] if y0 else [], holes[-1] if y0 + m.shape[0] < height else [], holes[:, 0] if x0 else [], holes[:, -1] if x0 + m.shape[1] < width else []]
    outer = np.unique(np.concatenate([np.asarray(c, int) for c in cut]))
    n[outer] += height * width - m.size
    m |= (n[holes] < area) & (holes > 0)
    ys, xs = np.nonzero(m)
    return ys + y0, xs + x0


def square_median(img: np.ndarray, size: int = 3) -> np.ndarray:
    r = size // 2
    big = np.pad(img, [(0, 0)] * (img.ndim - 2) + [(r, r)] * 2, mode="symmetric")
    return np.median(np.lib.stride_tricks.sliding_window_view(big, (size, size), axis=(-2, -1)), axis=(-2, -1))


def distance_transform(mask: np.ndarray) -> np.ndarray:
    """Euclidean distance of each foreground pixel to the nearest background pixel (infinite if there is none).

    First the distance along columns, then for each row the least over columns of its square plus that along the row.
    """
    h, w = mask.shape
    far = np.where(mask, np.inf, 0.0)
    for y in range(1, h):
        far[y] = np.minimum(far[y], far[y - 1] + 1)
    for y in range(h - 2, -1, -1):
        far[y] = np.minimum(far[y], far[y + 1] + 1)
    return row_distances(far)


def row_distances(far: np.ndarray) -> np.ndarray:
    """Distances from those along columns: for each pixel the least over its row of the square plus that of the step.

    Steps are tried shortest first, and only as long as any distance found is longer; rows that nowhere are finite stay
    infinite.
    """
    out = far**2
    w = far.shape[1]
    rows = np.flatnonzero(np.isfinite(far).any(axis=1)) if far.size else []
    if len(rows):
        squares = out[rows]
        best = squares.copy()
        for step in range(1, w):
            if best.max() <= step * step:
                break
            near = squares + step * step
            np.minimum(best[:, step:], near[:, :-step], out=best[:, step:])
            np.minimum(best[:, :-step], near[:, step:], out=best[:, :-step])
        out[rows] = best
    return np.sqrt(out)


def local_maxima(img: np.ndarray) -> np.ndarray:
    """Plateaus (8-connected parts of equal value) whose neighbours are all lower; a constant image has none."""
    h, w = img.shape
    big = np.pad(img.astype(float), 1, constant_values=-np.inf)
    beaten = np.zeros(img.shape, bool)
    level = np.zeros(img.shape, bool)
    for dy in range(3):
        for dx in range(3):
            if dy != 1 or dx != 1:
                near = big[dy : dy + h, dx : dx + w]
                beaten |= near > img
                level |= near == img
    out = ~beaten
    if (level & out).any():
        for value in np.unique(img[level & out]):
            parts = label(img == value)
            lost = np.unique(parts[beaten & (parts > 0)])
            out &= ~np.isin(parts, lost) | (parts == 0)
    if img.size and img.min() == img.max():
        out[:] = False
    return out


def resize(img: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Bilinear resampling at pixel centres, edges mirrored."""
    out = img.astype(float)
    for axis, n in enumerate(shape):
        m = out.shape[axis]
        at = np.clip((np.arange(n) + 0.5) * m / n - 0.5, 0, m - 1)
        lo = np.floor(at).astype(int)
        hi = np.minimum(lo + 1, m - 1)
        f = (at - lo).reshape([-1 if a == axis else 1 for a in range(out.ndim)])
        out = out.take(lo, axis) * (1 - f) + out.take(hi, axis) * f
    return out


def rescale(img: np.ndarray, scale: float) -> np.ndarray:
    return resize(img, (int(round(img.shape[0] * scale)), int(round(img.shape[1] * scale))))


def equalise_adaptive(img: np.ndarray, parts: int = 8, limit: float = 0.01, bins: int = 256) -> np.ndarray:
    """Contrast-limited equalisation: clipped histograms of a grid of blocks, blended bilinearly between block centres."""
    h, w = img.shape[-2:]
    by, bx = max(1, min(parts, h)), max(1, min(parts, w))
    flat = img.reshape(-1, h, w)
    some = max(1, (1 << 21) // (by * bx * bins))  # the histograms of so many images are held at once
    made = [_equalised(flat[at : at + some], by, bx, limit, bins) for at in range(0, len(flat), some)]
    return np.concatenate(made).reshape(img.shape) if made else np.zeros(img.shape)


def _equalised(img: np.ndarray, by: int, bx: int, limit: float, bins: int) -> np.ndarray:
    """equalise_adaptive() of a stack, with by * bx blocks."""
    m, h, w = img.shape
    lo, hi = img.min((1, 2), keepdims=True), img.max((1, 2), keepdims=True)
    flat = lo == hi
    level = np.minimum(((img - lo) / np.where(flat, 1, hi - lo) * bins).astype(int), bins - 1)
    own = np.arange(m)[:, None, None]
    ey, ex = np.linspace(0, h, by + 1).astype(int), np.linspace(0, w, bx + 1).astype(int)
    maps = np.empty((by, bx, m, bins))
    for i in range(by):
        for j in range(bx):
            block = level[:, ey[i] : ey[i + 1], ex[j] : ex[j + 1]]
            n = np.bincount((own * bins + block).ravel(), minlength=m * bins).astype(float).reshape(m, bins)
            total = block[0].size
            top = max(1.0, limit * total)
            spare = np.maximum(n - top, 0).sum(-1, keepdims=True)
            maps[i, j] = np.cumsum(np.minimum(n, top) + spare / bins, -1) / total
    cy, cx = (ey[:-1] + ey[1:] - 1) / 2, (ex[:-1] + ex[1:] - 1) / 2

    def place(c: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        k = np.interp(np.arange(n), c, np.arange(len(c)))
        a = np.floor(k).astype(int)
        return a, np.minimum(a + 1, len(c) - 1), k - a

    y0, y1, fy = place(cy, h)
    x0, x1, fx = place(cx, w)
    mix = np.zeros(img.shape)
    for ys, wy in ((y0, 1 - fy), (y1, fy)):
        for xs, wx in ((x0, 1 - fx), (x1, fx)):
            mix += wy[:, None] * wx[None] * maps[ys[:, None], xs[None], own, level]
    low = mix.min((1, 2), keepdims=True)
    return np.where(flat, 0.0, (mix - low) / np.maximum(mix.max((1, 2), keepdims=True) - low, 1e-300))


def noise_level(img: np.ndarray) -> float | np.ndarray:
    """Median absolute diagonal detail of a two-tap-pair wavelet (four coefficients), over 0.6745; one for each image."""
    r3 = math.sqrt(3)
    g = np.array([1 - r3, r3 - 3, 3 + r3, -1 - r3]) / (4 * math.sqrt(2))

    def detail(a: np.ndarray, axis: int) -> np.ndarray:
        pad = [(0, 0)] * a.ndim
        pad[axis] = (3, 3)
        big = np.pad(a, pad, mode="symmetric")
        n = (a.shape[axis] + 3) // 2
        return sum(x * big.take(np.arange(1, 1 + 2 * n, 2) + k, axis) for k, x in enumerate(g))

    d = np.abs(detail(detail(img, -2), -1)).reshape(*img.shape[:-2], -1)
    n = (d > 1e-12).sum(-1, keepdims=True)
    d = np.sort(np.where(d > 1e-12, d, np.inf), axis=-1)
    middle = [np.take_along_axis(d, np.clip(k, 0, d.shape[-1] - 1), -1) for k in ((n - 1) // 2, n // 2)]
    level = np.where(n > 0, (middle[0] + middle[1]) / 2 / 0.6744897501960817, 0.0)[..., 0]
    return level if level.ndim else float(level)


def nl_means(img: np.ndarray, patch: int = 5, distance: int = 35, strength: float = 1.2, noise: float | np.ndarray | None = None) -> np.ndarray:
    """Non-local means over pixels of the image up to `distance` away.

    Patch differences come from running sums for one shift at a time, so the cost doesn't depend on the patch size.
    Weights under exp(-5) count as none; images without noise stay.
    """
    img = img.astype(float)
    sigma = np.asarray(noise_level(img) if noise is None else noise, float)[..., None, None]
    h2 = (strength * sigma) ** 2
    if not (h2 != 0).any():
        return img
    still, h2 = h2 == 0, np.where(h2 == 0, 1.0, h2)
    r, (h, w) = patch // 2, img.shape[-2:]
    flat = [(0, 0)] * (img.ndim - 2)
    big = np.pad(img, [*flat, (r, r), (r, r)], mode="reflect" if min(h, w) > r else "edge")
    total, weight = np.zeros(img.shape), np.zeros(img.shape)
    for dy in range(-min(distance, h - 1), min(distance, h - 1) + 1):
        for dx in range(-min(distance, w - 1), min(distance, w - 1) + 1):
            y0, y1, x0, x1 = max(0, -dy), min(h, h - dy), max(0, -dx), min(w, w - dx)
            one = big[..., y0 : y1 + 2 * r, x0 : x1 + 2 * r]
            other = big[..., y0 + dy : y1 + dy + 2 * r, x0 + dx : x1 + dx + 2 * r]
            s = np.pad(((one - other) ** 2).cumsum(-2).cumsum(-1), [*flat, (1, 0), (1, 0)])
            d = (s[..., patch:, patch:] - s[..., :-patch, patch:] - s[..., patch:, :-patch] + s[..., :-patch, :-patch]) / patch**2
            d = np.maximum(d - 2 * sigma**2, 0) / h2
            k = np.where(d > 5, 0.0, np.exp(-d))
            total[..., y0:y1, x0:x1] += k * img[..., y0 + dy : y1 + dy, x0 + dx : x1 + dx]
            weight[..., y0:y1, x0:x1] += k
    return np.where(still, img, total / weight)
