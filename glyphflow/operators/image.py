"""Pixel kernels on NumPy arrays. ``scan``, ``gate``, ``vote`` and ``detect`` run them over rows."""

from __future__ import annotations

import numpy as np


def polygon_mask(points: list[list[int]], h: int, w: int) -> np.ndarray:
    """Pixels of an h x w image inside the polygon, edges included (even-odd rule)."""
    yy, xx = np.mgrid[0:h, 0:w]
    inside, edge = np.zeros((h, w), bool), np.zeros((h, w), bool)
    p = np.asarray(points, float)
    for (x1, y1), (x2, y2) in zip(p, np.roll(p, -1, axis=0)):
        if y1 != y2:
            inside ^= ((y1 > yy) != (y2 > yy)) & (xx < (x2 - x1) * (yy - y1) / (y2 - y1) + x1)
        span = np.abs((x2 - x1) * (yy - y1) - (y2 - y1) * (xx - x1)) < 1e-9
        edge |= span & (xx >= min(x1, x2)) & (xx <= max(x1, x2)) & (yy >= min(y1, y2)) & (yy <= max(y1, y2))
    return inside | edge


def changed_share(a: np.ndarray, b: np.ndarray, delta: int = 10) -> float:
    """Share of pixels that differ by more than ``delta``; 1 for other shapes."""
    return float(changed_shares(a[None], b[None], delta)[0]) if a.shape == b.shape else 1.0


def changed_shares(a: np.ndarray, b: np.ndarray, delta: int = 10) -> np.ndarray:
    """The same for each pair of two stacks (n x h x w) of images of one shape."""
    if not a[:1].size:
        return np.zeros(len(a))
    return (np.abs(a.astype(int) - b.astype(int)) > max(1, delta)).reshape(len(a), -1).mean(1)


def structural_similarity(a: np.ndarray, b: np.ndarray, size: int = 7) -> float:
    """Mean similarity over uniform windows of gray images with values to 255; 0 for other shapes."""
    return float(structural_similarities(a[None], b[None], size)[0]) if a.shape == b.shape else 0.0


def structural_similarities(a: np.ndarray, b: np.ndarray, size: int = 7) -> np.ndarray:
    """The same for each pair of two stacks (n x h x w) of images of one shape."""
    if min(a.shape[1:]) < size:
        return (a == b).reshape(len(a), a.shape[1] * a.shape[2]).all(1).astype(float)
    a, b = a.astype(float), b.astype(float)

    def mean(x: np.ndarray) -> np.ndarray:
        s = np.pad(x, ((0, 0), (1, 0), (1, 0))).cumsum(1).cumsum(2)
        return (s[:, size:, size:] - s[:, :-size, size:] - s[:, size:, :-size] + s[:, :-size, :-size]) / size**2

    n = size**2 / (size**2 - 1)
    ma, mb = mean(a), mean(b)
    va, vb, cov = n * (mean(a * a) - ma**2), n * (mean(b * b) - mb**2), n * (mean(a * b) - ma * mb)
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    return (((2 * ma * mb + c1) * (2 * cov + c2)) / ((ma**2 + mb**2 + c1) * (va + vb + c2))).reshape(len(a), -1).mean(1)


def hsv(bgr: np.ndarray) -> np.ndarray:
    """Hue to 180, saturation and value to 255."""
    x = bgr.astype(float) / 255
    b, g, r = x[..., 0], x[..., 1], x[..., 2]
    top, low = x.max(-1), x.min(-1)
    d = np.where(top > low, top - low, 1)
    hue = np.where(top == r, (g - b) / d % 6, np.where(top == g, (b - r) / d + 2, (r - g) / d + 4)) * 30
    return np.stack([np.where(top > low, hue, 0), np.where(top > 0, (top - low) / np.where(top > 0, top, 1), 0) * 255, top * 255], -1).round().astype(int)


def presence_share(bgr: np.ndarray, mask: np.ndarray | None, bounds: list[tuple]) -> float:
    """Share of masked pixels whose colour lies in any of the bounds (lower, upper)."""
    x = hsv(bgr)
    mask = np.ones(x.shape[:2], bool) if mask is None else mask > 0
    hit = np.zeros(mask.shape, bool)
    for lo, hi in bounds:
        hit |= ((x >= np.asarray(lo)) & (x <= np.asarray(hi))).all(-1)
    return float((hit & mask).sum() / mask.sum()) if mask.any() else 0.0


def restrict_colours(bgr: np.ndarray, colours: list[tuple], tolerance: int = 40, kernel: int = 3) -> np.ndarray:
    """Pixels near one of the colours, closed by an odd round kernel; the others white. Nothing near: unchanged."""
    tolerance, kernel = min(120, max(1, tolerance)), min(15, max(1, kernel)) | 1
    near = np.zeros(bgr.shape[:2], bool)
    for c in colours:
        near |= (np.abs(bgr.astype(int) - np.asarray(c)) <= tolerance).all(-1)
    if not near.any():
        return bgr
    round_ = _ellipse(kernel)
    near = _morph(_morph(near, round_, False), round_, True)
    return np.where(near[..., None], bgr, 255).astype(bgr.dtype)


def dark_borders(gray: np.ndarray) -> tuple[float, float]:
    """Shares of dark pixels (under 15) in the strips of 5 percent above and below, and left and right."""
    h, w = gray.shape
    a, b = max(1, h // 20), max(1, w // 20)
    dark = gray < 15
    return float((dark[:a].mean() + dark[-a:].mean()) / 2), float((dark[:, :b].mean() + dark[:, -b:].mean()) / 2)


def gray(bgr: np.ndarray) -> np.ndarray:
    """Luminance of 8-bit BGR, rounded."""
    return (bgr[..., 0] * 0.114 + bgr[..., 1] * 0.587 + bgr[..., 2] * 0.299 + 0.5).astype(np.uint8)


def decode(data: bytes, h: int, w: int) -> np.ndarray:
    """The h x w x 3 image of raw BGR bytes."""
    return np.frombuffer(data, np.uint8).reshape(h, w, 3)


def region_box(kind: str, points, h: int, w: int, least: int = 2) -> tuple[int, int, int, int] | None:
    """(x1, y1, x2, y2) of a region within an h x w image, or None if it is ill-formed or nothing is left."""
    if kind == "rect":
        if not isinstance(points, list) or len(points) != 4:
            return None
        x, y, dx, dy = (int(p) for p in points)
        box = max(0, x), max(0, y), min(w, x + dx), min(h, y + dy)
    elif kind == "poly":
        if not isinstance(points, list) or len(points) < least or any(not isinstance(p, list) or len(p) != 2 for p in points):
            return None
        p = clipped(points, h, w)
        box = int(p[:, 0].min()), int(p[:, 1].min()), int(p[:, 0].max()) + 1, int(p[:, 1].max()) + 1
    else:
        return None
    return box if box[2] > box[0] and box[3] > box[1] else None


def clipped(points, h: int, w: int) -> np.ndarray:
    return np.clip(np.asarray(points, np.int64), 0, [w - 1, h - 1])


def crop(bgr: np.ndarray, kind: str, points, outside: int = 0, least: int = 2) -> tuple[np.ndarray, np.ndarray, tuple] | None:
    """(pixels, mask, box) of a region: a copy, with what lies outside a polygon set to ``outside``; None without any."""
    h, w = bgr.shape[:2]
    box = region_box(kind, points, h, w, least)
    if box is None:
        return None
    x1, y1, x2, y2 = box
    out = bgr[y1:y2, x1:x2].copy()
    mask = np.ones(out.shape[:2], bool)
    if kind == "poly":
        mask = polygon_mask((clipped(points, h, w) - [x1, y1]).tolist(), y2 - y1, x2 - x1)
        out[~mask] = outside
    return out, mask, box


def blur(bgr: np.ndarray) -> np.ndarray:
    """A 3 x 3 Gaussian (1 2 1 each way), edges mirrored without repeating them."""
    mode = "reflect" if min(bgr.shape[:2]) > 1 else "edge"
    p = np.pad(bgr.astype(np.int32), ((1, 1), (1, 1), (0, 0)), mode=mode)
    p = p[:-2] + 2 * p[1:-1] + p[2:]
    return ((p[:, :-2] + 2 * p[:, 1:-1] + p[:, 2:] + 8) >> 4).astype(np.uint8)


def preprocess(bgr: np.ndarray, restrict: dict | None, blurred: bool) -> np.ndarray:
    """Colour restriction, then a light blur, as a region asks for."""
    if bgr.size and restrict and restrict.get("enabled"):
        colours = [restrict[k] for k in ("text_bgr", "outline_bgr", "shadow_bgr") if restrict.get(k) is not None and len(restrict[k]) == 3]
        pick = lambda k, usual: usual if restrict.get(k) is None else int(restrict[k])
        bgr = restrict_colours(bgr, colours, pick("tolerance", 40), pick("morph_kernel", 3))
    return blur(bgr) if blurred and bgr.size else bgr


def composite(bgr: np.ndarray, regions: list[dict], background: tuple[int, int, int] = (255, 255, 255)) -> np.ndarray:
    """The frame with only its regions' pixels, in order: later ones lie above."""
    canvas = np.empty_like(bgr)
    canvas[:] = background
    for r in regions:
        box = region_box(r["type"], r["points"], *bgr.shape[:2])
        if box is not None:
            x1, y1, x2, y2 = box
            own = preprocess(bgr[y1:y2, x1:x2].copy(), r.get("color_restrict"), bool(r.get("blur_enabled")))
            mask = crop(bgr, r["type"], r["points"])[1]
            canvas[y1:y2, x1:x2][mask] = own[mask]
    return canvas


def calibrate(bgr: np.ndarray, mask: np.ndarray | None = None, margin: float = 15) -> list[tuple]:
    """Bounds (lower, upper) in HSV of a saturated and of a light colour: those of masked pixels, or the usual ones.

    The saturated bounds lie around the mean of pixels that are neither light nor dull, if there are eight.
    """
    x = hsv(bgr).reshape(-1, 3).astype(float)
    own = x[mask.reshape(-1) > 0] if mask is not None and mask.size == len(x) else x
    own = own if len(own) >= 16 else x
    light = (own[:, 1] < 55) & (own[:, 2] > 165)
    lively = own[~light & (own[:, 1] > 60) & (own[:, 2] > 45)]
    #: Bounds without calibration.
    lo, hi = (0, 90, 90), (35, 255, 255)
    if len(lively) >= 8:
        mean = lively.mean(axis=0)
        lo = tuple(int(v) for v in np.maximum(mean - margin, (0, 40, 40)))
        hi = tuple(int(v) for v in np.minimum(mean + margin, (179, 255, 255)))
    return [(lo, hi), ((0, 0, 170), (180, 55, 255))]


def colour_features(bgr: np.ndarray) -> dict[str, float]:
    """Mean saturation, 1 - the share of the fullest of 32 hue bins, and the variance of brightness."""
    x = hsv(bgr)
    bins = np.bincount(np.minimum(x[..., 0].ravel() * 32 // 180, 31), minlength=32)
    return {"color_saturation": float(x[..., 1].mean() / 255), "color_histogram_spread": float(1 - bins.max() / bins.sum()), "brightness_variance": float((x[..., 2] / 255.0).var())}


def _sobel(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = np.pad(g.astype(np.int32), 1, mode="edge")
    across, down = p[:, 2:] - p[:, :-2], p[2:] - p[:-2]
    return across[:-2] + 2 * across[1:-1] + across[2:], down[:, :-2] + 2 * down[:, 1:-1] + down[:, 2:]


def edges(g: np.ndarray, low: int = 50, high: int = 150) -> np.ndarray:
    """Edge pixels: steepest across their edge, over ``high``, or over ``low`` and linked to one over ``high``."""
    if min(g.shape) < 3:
        return np.zeros(g.shape, bool)
    dx, dy = _sobel(g)
    size = np.abs(dx) + np.abs(dy)
    p = np.pad(size, 1)
    at = lambda y, x: p[1 + y : p.shape[0] - 1 + y, 1 + x : p.shape[1] - 1 + x]
    flat, steep = np.abs(dy) * 1000 < np.abs(dx) * 414, np.abs(dx) * 1000 < np.abs(dy) * 414
    slant = (dx ^ dy) >= 0
    before = np.where(flat, at(0, -1), np.where(steep, at(-1, 0), np.where(slant, at(-1, -1), at(-1, 1))))
    after = np.where(flat, at(0, 1), np.where(steep, at(1, 0), np.where(slant, at(1, 1), at(1, -1))))
    thin = (size > before) & (size >= after)
    weak, strong = thin & (size > low), thin & (size > high)
    while True:  # strength spreads along weak pixels
        p2 = np.pad(strong, 1)
        near = np.zeros_like(strong)
        for y in (0, 1, 2):
            for x in (0, 1, 2):
                near |= p2[y : y + g.shape[0], x : x + g.shape[1]]
        grown = strong | (weak & near)
        if (grown == strong).all():
            return strong
        strong = grown


def otsu(g: np.ndarray) -> np.ndarray:
    """Pixels above the threshold that parts the histogram into classes furthest apart."""
    n = np.bincount(g.ravel(), minlength=256).astype(float)
    below = n.cumsum()
    sums = (n * np.arange(256)).cumsum()
    above = below[-1] - below
    apart = np.where((below > 0) & (above > 0), (sums[-1] * below - below[-1] * sums) ** 2 / np.maximum(below * above, 1), -1)
    return g > int(apart.argmax())


def _ellipse(size: int) -> np.ndarray:
    r = size // 2
    y = np.arange(size) - r
    reach = np.rint(r * np.sqrt(np.maximum(r * r - y * y, 0)) / max(r, 1)).astype(int)
    return np.abs(np.arange(size) - r)[None, :] <= reach[:, None]


def _morph(m: np.ndarray, kernel: np.ndarray, shrink: bool) -> np.ndarray:
    r = kernel.shape[0] // 2
    p, out = np.pad(m, r, constant_values=shrink), np.full(m.shape, shrink)
    for dy, dx in zip(*np.nonzero(kernel)):
        part = p[dy : dy + m.shape[0], dx : dx + m.shape[1]]
        out = out & part if shrink else out | part
    return out


def has_stroke(bgr: np.ndarray) -> bool:
    """The ring between two steps of growing and two of shrinking is a tenth to half of the text's pixels."""
    text, kernel = otsu(gray(bgr)), _ellipse(5)
    grown, left = text, text
    for _ in range(2):
        grown, left = _morph(grown, kernel, False), _morph(left, kernel, True)
    return bool(0.10 < (grown & ~left).sum() / max(text.sum(), 1) < 0.50)


def has_box(bgr: np.ndarray) -> bool:
    """The strip above or below is nearly of one brightness."""
    g = gray(bgr).astype(float)
    if g.shape[0] < 6:
        return False
    n = max(1, g.shape[0] // 6)
    even = lambda s: 1 - min(1.0, float(np.abs(s - s.mean()).mean()) / 50)
    return max(even(g[:n]), even(g[-n:])) > 0.75


def contrast(bgr: np.ndarray) -> float:
    """How far the mean of the middle lies from that of the border, 0 to 1."""
    g = gray(bgr).astype(float)
    h, w = g.shape
    if h < 6 or w < 6:
        return 0.0
    y, x = max(1, h // 3), max(1, w // 3)
    a, b = max(1, h // 10), max(1, w // 10)
    border = np.concatenate([g[:a].ravel(), g[-a:].ravel(), g[:, :b].ravel(), g[:, -b:].ravel()])
    return float(min(1.0, abs(g[h // 2 - y : h // 2 + y, w // 2 - x : w // 2 + x].mean() - border.mean()) / 255))


def perspective(corners) -> float:
    """0 for opposite edges in parallel to 1; other than four corners are 0."""
    p = np.asarray(corners, float)
    if p.shape != (4, 2):
        return 0.0

    def angle(a: np.ndarray, b: np.ndarray) -> float:
        return float(np.arccos(np.clip(abs(a @ b / (np.linalg.norm(a) * np.linalg.norm(b) + 1e-8)), 0, 1)))

    return min(1.0, (angle(p[1] - p[0], p[2] - p[3]) + angle(p[3] - p[0], p[2] - p[1])) / (np.pi / 2))


def stroke_width(bgr: np.ndarray) -> float | None:
    """The median length of runs of text pixels along rows; None without any."""
    text = np.pad(otsu(gray(bgr)), ((0, 0), (1, 1))).astype(np.int8)
    step = np.diff(text, axis=1)
    runs = np.nonzero(step == -1)[1] - np.nonzero(step == 1)[1]
    return float(np.median(runs)) if len(runs) else None


def font_diversity(regions: list[np.ndarray]) -> float:
    """0 to 1: how much heights, colours and strokes of text regions differ; under three regions 0."""
    if len(regions) < 3:
        return 0.0
    heights, colours = [r.shape[0] for r in regions], [float(r.mean()) for r in regions]
    strokes = [s for s in map(stroke_width, regions) if s is not None]
    if not strokes:
        return 0.0
    spread = lambda v: float(np.var(v) / (np.mean(v) ** 2 + 1e-6))
    return float(np.clip((spread(heights) + np.var(colours) / 10000 + spread(strokes)) / 3, 0, 1))
