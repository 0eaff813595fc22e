"""What columns can't express: optimal matching, polygon clipping, connected components, resampling, hashing with many endings."""

from __future__ import annotations

import hashlib
import math

import numpy as np


def best_assignment(weight: np.ndarray) -> list[tuple[int, int]]:
    """Row and column pairs of the largest total weight, every row of a matrix with no more rows than columns used once.

    Shortest augmenting paths with potentials: rows are added one at a time, each along the cheapest alternating path.
    """
    cost = -weight
    n, m = cost.shape
    row_price, col_price = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)
    for new in range(n):
        slack = cost[new] - row_price[new] - col_price
        came = np.full(m, -1)
        done = np.zeros(m, bool)
        base = 0.0
        while True:
            open_ = np.where(done, np.inf, slack)
            j = int(open_.argmin())
            base = open_[j]
            done[j] = True
            if owner[j] < 0:
                break
            i = owner[j]
            through = base + cost[i] - row_price[i] - col_price
            better = ~done & (through < slack)
            slack[better], came[better] = through[better], j
        before = done.copy()
        before[j] = False
        row_price[new] += base
        row_price[owner[before]] += base - slack[before]
        col_price[before] -= base - slack[before]
        while came[j] >= 0:
            owner[j] = owner[came[j]]
            j = came[j]
        owner[j] = new
    return [(int(owner[j]), j) for j in range(m) if owner[j] >= 0]


def _first_of(*sorted_columns: np.ndarray) -> np.ndarray:
    """Whether each row differs from the one before it."""
    new = np.zeros(len(sorted_columns[0]), bool)
    new[:1] = True
    for c in sorted_columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _numbered(group: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """A number from 0 for each (group, id)."""
    order = np.lexsort((ids, group))
    out = np.empty(len(ids), np.int64)
    out[order] = np.cumsum(_first_of(group[order], ids[order])) - 1
    return out


def _greatest(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    np.maximum.at(out, at, values)
    return out


def _stars(p: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of edges between numbered nodes: whether the left (or the right) node is the centre of a component in which one node touches all others."""
    dp, dr = np.bincount(p), np.bincount(r)
    left = _greatest(p, dr[r], len(dp))[p] == 1
    return left, ~left & (_greatest(r, dp[p], len(dr))[r] == 1)


def optimal_pairs(group: np.ndarray, pred: np.ndarray, ref: np.ndarray, iou: np.ndarray) -> np.ndarray:
    """Which valid edges of many groups are one-to-one pairs: as many as possible in each group, and of those the largest total IoU.

    Both goals add up over the components of the graph. One in which a node touches all others gives its best edge, all of
    them at once; the others are solved one by one.
    """
    if not len(iou):
        return np.zeros(0, np.int64)
    p, r = _numbered(group, pred), _numbered(group, ref)
    left, right = _stars(p, r)
    centre = np.where(left, p, len(iou) + r)
    order = np.lexsort((ref, pred, -iou, centre))
    order = order[(left | right)[order]]
    out = [order[_first_of(centre[order])]]
    rest = np.flatnonzero(~(left | right))
    if len(rest):
        p, r = (np.unique(x[rest], return_inverse=True)[1] for x in (p, r))
        label = np.arange(p.max() + 1)
        while True:  # the least left node of each component
            by_ref = np.full(r.max() + 1, len(label))
            np.minimum.at(by_ref, r, label[p])
            new = label.copy()
            np.minimum.at(new, p, by_ref[r])
            if (new == label).all():
                break
            label = new
        component = label[p]
        order = np.argsort(component, kind="stable")
        for own in np.split(order, np.flatnonzero(_first_of(component[order]))[1:]):
            a, x = np.unique(p[own], return_inverse=True)
            b, y = np.unique(r[own], return_inverse=True)
            edge = np.full((len(a), len(b)), -1)
            edge[x, y] = rest[own]
            weight = np.zeros(edge.shape)
            weight[x, y] = min(len(a), len(b)) + 1 + iou[rest[own]]  # a pair more outweighs any IoU
            pairs = best_assignment(weight) if len(a) <= len(b) else [(i, j) for j, i in best_assignment(weight.T)]
            out.append(np.array([edge[i, j] for i, j in pairs if edge[i, j] >= 0], np.int64))
    return np.sort(np.concatenate(out))


def optimal_match(pred: np.ndarray, ref: np.ndarray, iou: np.ndarray) -> list[tuple[int, int, float]]:
    """The pairs of one group."""
    own = optimal_pairs(np.zeros(len(iou), np.int64), pred, ref, iou)
    return [(int(pred[i]), int(ref[i]), float(iou[i])) for i in own]


def most_pairs(p: np.ndarray, r: np.ndarray, bin_of: np.ndarray, bins: int) -> np.ndarray:
    """How many one-to-one pairs there are at most in each bin; p and r: the edges' numbered nodes, bin_of: each left node's bin."""
    if not len(p):
        return np.zeros(bins, np.int64)
    left, right = _stars(p, r)
    centres = np.unique(p[left])
    out = np.bincount(bin_of[centres], minlength=bins)
    _, at = np.unique(r[right], return_index=True)
    out += np.bincount(bin_of[p[right][at]], minlength=bins)
    rest = np.flatnonzero(~(left | right))
    near: dict[int, list[int]] = {}
    for x, y in zip(p[rest].tolist(), r[rest].tolist(), strict=True):
        near.setdefault(x, []).append(y)
    owner: dict[int, int] = {}

    def placed(x: int, tried: set[int]) -> bool:
        for y in near[x]:
            if y not in tried:
                tried.add(y)
                if y not in owner or placed(owner[y], tried):
                    owner[y] = x
                    return True
        return False

    for x in near:
        if placed(x, set()):
            out[bin_of[x]] += 1
    return out


#: MD5's constants: what is added in each step, and by how much is rotated.
_MD5_ADDED = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_MD5_TURNED = [n for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for n in four * 4]
_MD5_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


class Texts:
    """Texts (UTF-8, as Arrow holds them) that are hashed with many endings. Those of one length are hashed together, array by array."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray):
        self.n, self.by_size, sizes = len(offsets) - 1, [], np.diff(offsets)
        for size in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == size)
            raw = np.zeros((len(at), -(-size // 4) * 4), np.uint8)
            raw[:, :size] = data[offsets[at][:, None] + np.arange(size)]
            self.by_size.append((size, at, raw, np.ascontiguousarray(raw.view("<u4").T)))

    def uniform(self, ending: bytes) -> np.ndarray:
        """What boxes.hash_uniform makes of each text with the ending: a number in [0, 1)."""
        out = np.empty(self.n, np.float64)
        for size, at, raw, words in self.by_size:
            if size + len(ending) <= 55:
                out[at] = _md5_heads(words, size, ending)
            else:  # more than a block
                out[at] = [int.from_bytes(hashlib.md5(row[:size].tobytes() + ending, usedforsecurity=False).digest()[:4], "big") for row in raw]
        return out / 4294967296.0


def _md5_heads(words: np.ndarray, size: int, ending: bytes, step: int = 16384) -> np.ndarray:
    """The first 4 bytes of the MD5 of texts of `size` bytes (words: word by word, zeros after the end) with an ending, one block in all."""
    rest = bytearray(64)
    rest[size : size + len(ending) + 1] = ending + b"\x80"
    rest[56:] = (8 * (size + len(ending))).to_bytes(8, "little")
    rest = np.frombuffer(bytes(rest), "<u4")
    out = np.empty(words.shape[1], np.uint32)
    for lo in range(0, len(out), step):
        own = [w[lo : lo + step] | r for w, r in zip(words, rest, strict=False)]
        n = min(step, len(out) - lo)
        a, b, c, d = (np.full(n, x, np.uint32) for x in _MD5_START)
        f, more = np.empty(n, np.uint32), np.empty(n, np.uint32)
        for i in range(61):  # the last three steps make the other words
            if i < 16:
                g = i
                np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
            elif i < 32:
                g = (5 * i + 1) % 16
                np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
            elif i < 48:
                g = (3 * i + 5) % 16
                np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
            else:
                g = (7 * i) % 16
                np.invert(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
            np.add(f, a, out=f)
            if g < len(own):
                np.add(f, own[g], out=f), np.add(f, np.uint32(_MD5_ADDED[i]), out=f)
            else:
                np.add(f, np.uint32((_MD5_ADDED[i] + int(rest[g])) & 0xFFFFFFFF), out=f)
            turn = _MD5_TURNED[i]
            np.left_shift(f, np.uint32(turn), out=more), np.right_shift(f, np.uint32(32 - turn), out=f), np.bitwise_or(f, more, out=f)
            np.add(f, b, out=a)
            a, b, c, d = d, a, b, c
        np.add(b, np.uint32(_MD5_START[0]), out=out[lo : lo + step])
    return out.byteswap()


def overlapping(box: list[np.ndarray], ref: list[np.ndarray], p: np.ndarray, r: np.ndarray, least: float, step: int = 32768) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs (p, r) of boxes and references (x0, y0, x1, y1) those whose IoU is `least` or more, and the IoU, as matching.edges
    finds them (as in SQL, what is not a number is above all numbers; boxes hold numbers only)."""
    (x0, y0, x1, y1), (rx0, ry0, rx1, ry1) = box, ref
    top = lambda v: np.where(np.isnan(v), np.inf, v)
    tx, ty, area, found = top(rx1), top(ry1), (rx1 - rx0) * (ry1 - ry0), []
    for lo in range(0, len(p), step):
        i, k = p[lo : lo + step], r[lo : lo + step]
        at = np.flatnonzero((x0[i] < tx[k]) & (rx0[k] < x1[i]))
        i, k = i[at], k[at]
        at = np.flatnonzero((y0[i] < ty[k]) & (ry0[k] < y1[i]))
        i, k = i[at], k[at]
        both = (np.minimum(x1[i], tx[k]) - np.maximum(x0[i], rx0[k])) * (np.minimum(y1[i], ty[k]) - np.maximum(y0[i], ry0[k]))
        union = (x1[i] - x0[i]) * (y1[i] - y0[i]) + area[k] - both
        with np.errstate(divide="ignore", invalid="ignore"):
            iou = both / union
        at = np.flatnonzero((union != 0) & ~(iou <= 0) & ~(iou < least))
        found.append((i[at], k[at], iou[at]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (p[:0], r[:0], np.zeros(0))


def drawn_pairs(names, box: list[np.ndarray], ref: list[np.ndarray], sound: np.ndarray, chip_of: np.ndarray, refs_of: np.ndarray, extent: float, n_rep: int, least: float, step: int = 1 << 20) -> list[tuple[np.ndarray, ...]]:
    """The pairs of boxes and their chip's references by an IoU of `least` or more, where the boxes are, and in n_rep repetitions that put
    each where baseline.relocate_uniform does and clip it: box, reference, repetition, IoU.

    names: what a box's draw depends on (an Arrow array); sound: of references, those with a box; chip_of: each box's chip; refs_of: of each
    chip how many references it has. Pairs are made for some boxes at a time.
    """
    first, many = np.cumsum(refs_of) - refs_of, refs_of[chip_of]
    done, out = np.cumsum(many), [[], []]
    offsets = np.frombuffer(names.buffers()[1], np.int32)[names.offset : names.offset + len(names) + 1] if len(names) else np.zeros(1, np.int32)
    data = np.frombuffer(names.buffers()[2], np.uint8) if len(names) else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(chip_of):
        hi = max(lo + 1, int(np.searchsorted(done, (done[lo - 1] if lo else 0) + step, "right")))
        n = many[lo:hi]
        p = np.repeat(np.arange(hi - lo), n)
        r = np.arange(len(p)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[chip_of[lo:hi]], n)
        if not sound.all():
            p, r = p[sound[r]], r[sound[r]]
        own = [c[lo:hi] for c in box]
        if len(p):
            i, k, iou = overlapping(own, ref, p, r, least)
            out[0].append((i + lo, k, np.zeros(len(i), np.int64), iou))
            texts, (x0, y0, x1, y1) = Texts(offsets[lo : hi + 1], data), own
            w, h = x1 - x0, y1 - y0
            clipped = lambda v: np.maximum(0.0, np.minimum(v, extent))
            for rep in range(n_rep):
                nx, ny = (texts.uniform(f"|{rep}|{axis}".encode()) * np.maximum(0.0, extent - size) for axis, size in (("x", w), ("y", h)))
                i, k, iou = overlapping([clipped(nx), clipped(ny), clipped(nx + w), clipped(ny + h)], ref, p, r, least)
                out[1].append((i + lo, k, np.full(len(i), rep), iou))
        lo = hi
    nothing = [(np.zeros(0, np.int64),) * 3 + (np.zeros(0),)]
    return [tuple(np.concatenate(c) for c in zip(*(x or nothing), strict=True)) for x in out]


def _clip_half(points: list, axis: int, limit: float, sign: int) -> list:
    """Of a ring, what lies on one side of an axis-parallel line."""
    out = []
    for k, q in enumerate(points):
        p = points[k - 1]
        dp, dq = sign * (p[axis] - limit), sign * (q[axis] - limit)
        if (dp < 0) != (dq < 0):
            t = dp / (dp - dq)
            out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
        if dq >= 0:
            out.append((q[0], q[1]))
    return out


def ring_in_box_area(ring: list, x0: float, y0: float, x1: float, y1: float) -> float:
    points = [(float(x), float(y)) for x, y in ring]
    for axis, limit, sign in ((0, x0, 1), (0, x1, -1), (1, y0, 1), (1, y1, -1)):
        points = _clip_half(points, axis, limit, sign)
        if not points:
            return 0.0
    a = np.array(points)
    b = np.roll(a, -1, axis=0)
    return abs(float((a[:, 0] * b[:, 1] - b[:, 0] * a[:, 1]).sum())) / 2


def polygon_in_box_area(rings: list, box: tuple) -> float:
    """Area of a polygon (exterior, then holes) within a box."""
    return ring_in_box_area(rings[0], *box) - sum(ring_in_box_area(h, *box) for h in rings[1:]) if rings else 0.0


def component_boxes(mask: np.ndarray, eight: bool = False, least: int = 1) -> list[tuple[int, int, int, int, int]]:
    """x0, y0, x1, y1 (half open) and pixels of each connected component, by flood of least labels."""
    h, w = mask.shape
    label = np.where(mask, np.arange(h * w).reshape(h, w), h * w)
    shifts = [(0, 1), (1, 0), *([(1, 1), (1, -1)] if eight else [])]
    while True:
        new = label.copy()
        for dy, dx in shifts:
            ys, yd = slice(0, h - dy), slice(dy, h)
            xs, xd = (slice(0, w - dx), slice(dx, w)) if dx >= 0 else (slice(-dx, w), slice(0, w + dx))
            both = mask[ys, xs] & mask[yd, xd]
            least_ = np.minimum(new[ys, xs], new[yd, xd])
            new[ys, xs] = np.where(both, least_, new[ys, xs])
            new[yd, xd] = np.where(both, least_, new[yd, xd])
        if (new == label).all():
            break
        label = new
    out = []
    for c in np.unique(label[mask]):
        y, x = np.nonzero(label == c)
        if len(y) >= least:
            out.append((int(x.min()), int(y.min()), int(x.max()) + 1, int(y.max()) + 1, len(y)))
    return out


def _average(n: int, m: int) -> np.ndarray:
    """m x n: each target pixel the mean of the source pixels it covers, by share."""
    edge = np.arange(m + 1) * (n / m)
    lo, hi = np.arange(n), np.arange(1, n + 1)
    cover = np.minimum(edge[1:, None], hi) - np.maximum(edge[:-1, None], lo)
    return np.maximum(cover, 0) * (m / n)


def _interpolate(n: int, m: int, kernel, reach: int) -> np.ndarray:
    centre = (np.arange(m) + 0.5) * (n / m) - 0.5
    out = np.zeros((m, n))
    for d in range(1 - reach, reach + 1):
        at = np.floor(centre).astype(int) + d
        np.add.at(out, (np.arange(m), np.clip(at, 0, n - 1)), kernel(centre - at))
    return out


def _cubic(x: np.ndarray, a: float = -0.75) -> np.ndarray:
    x = np.abs(x)
    near = (a + 2) * x**3 - (a + 3) * x**2 + 1
    far = a * x**3 - 5 * a * x**2 + 8 * a * x - 4 * a
    return np.where(x <= 1, near, np.where(x < 2, far, 0.0))


def _linear(x: np.ndarray) -> np.ndarray:
    return np.maximum(1 - np.abs(x), 0)


def _blur(n: int, sigma: float) -> np.ndarray:
    half = int(np.ceil(3 * sigma))
    g = np.exp(-(np.arange(-half, half + 1) ** 2) / (2 * sigma**2))
    g /= g.sum()
    out = np.zeros((n, n))
    for d in range(-half, half + 1):
        at = np.abs(np.arange(n) + d)
        at = np.where(at > n - 1, 2 * (n - 1) - at, at) if n > 1 else np.zeros(n, int)
        np.add.at(out, (np.arange(n), np.clip(at, 0, n - 1)), g[d + half])
    return out


def target_pixels(pixels: int, native: float, target: float) -> int:
    """Pixels along a side after resampling, halves up; fixed values, so that sizes equal the published ones: a half and 1e-9."""
    return max(1, int(np.floor(pixels * native / target + 0.5 + 1e-9)))


def degrade(image: np.ndarray, native: float, target: float, method: str = "area", up: str = "cubic", blur: float = 0.5) -> np.ndarray:
    """An image (height, width, bands; uint8) as a sensor of `target` metres per pixel sees it, at its own size again."""
    if method not in ("area", "blur_resize") or up not in ("cubic", "linear"):
        raise ValueError(f"unknown method {method} or upsampling {up}")
    if image.dtype != np.uint8:
        raise ValueError("uint8 only")
    if target <= native + 1e-9:
        return image.copy()
    sides = [(n, target_pixels(n, native, target)) for n in image.shape[:2]]
    down = [_average(n, m) if method == "area" else _interpolate(n, m, _linear, 1) @ _blur(n, blur * target / native) for n, m in sides]
    return resized(_applied(image, *down), image.shape[:2], up)


def _applied(image: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """An image times a matrix on either side, rounded to bytes as a stored image is."""
    data = image.astype(float)
    done = np.einsum("yi,xj,ijc->yxc", rows, columns, data if data.ndim == 3 else data[:, :, None], optimize=True)
    return np.clip(np.rint(done), 0, 255).astype(np.uint8).reshape(len(rows), len(columns), *image.shape[2:])


def resized(image: np.ndarray, size: tuple[int, int], up: str = "cubic") -> np.ndarray:
    """An image at another size, by bicubic or bilinear interpolation."""
    kernel, reach = (_cubic, 2) if up == "cubic" else (_linear, 1)
    return _applied(image, *(_interpolate(n, m, kernel, reach) for n, m in zip(image.shape[:2], size, strict=True)))


def colour_mask(image: np.ndarray, red: int, over_green: int, over_blue: int) -> np.ndarray:
    r, g, b = (image[:, :, i].astype(np.int16) for i in range(3))
    return (r > red) & (r - g > over_green) & (r - b > over_blue)
