"""Page images as arrays of gray values (Python: array arithmetic has no built-in columns). Functions of numpy arrays, and columns made of them.

Decoding is Spark's image source; images are written as PNG, which needs no codec. JPEG, HEIC and EXIF rotation would need one that is not part of this library.
"""

from __future__ import annotations

import struct as packing
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StructType

from quire.schemas import IMAGES, struct
from quire.shipping import ship

#: Sizes and thresholds.
LONG_EDGE, MOST_EDGE, MOST_SCALE = 2200, 3600, 2.5
SPREAD_RATIO, SPREAD_WIDTH, TRANSITION = 1.15, 400, 20
CELL_PART, PAPER_QUANTILE, DARK_PAPER = 60, 0.9, 40
STRETCH_PART, STRETCH_STEP = 0.01, 3
FIGURE_CELLS, INK, TONE, EDGE, CLOSED = 70, 0.03, 0.25, 0.04, 6


def luma(bgr: np.ndarray) -> np.ndarray:
    """Gray values of an image with blue, green, red as its last axis."""
    x = bgr.astype(np.uint32)
    return ((77 * x[..., 2] + 150 * x[..., 1] + 29 * x[..., 0]) >> 8).astype(np.uint8)


def resized(gray: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear."""
    h, w = gray.shape
    ys, xs = (np.clip((np.arange(n) + 0.5) * size / n - 0.5, 0, size - 1) for n, size in ((height, h), (width, w)))
    y, x = np.floor(ys).astype(int), np.floor(xs).astype(int)
    y2, x2 = np.minimum(y + 1, h - 1), np.minimum(x + 1, w - 1)
    fy, fx = (ys - y)[:, None], (xs - x)[None, :]
    g = gray.astype(np.float64)
    top, low = g[y][:, x] * (1 - fx) + g[y][:, x2] * fx, g[y2][:, x] * (1 - fx) + g[y2][:, x2] * fx
    return top * (1 - fy) + low * fy


def recognition_scale(width: int, height: int) -> float:
    """By how much to enlarge or shrink a page so that its long edge suits recognition."""
    edge = max(width, height)
    if edge < LONG_EDGE:
        return min(MOST_SCALE, LONG_EDGE / edge)
    return MOST_EDGE / edge if edge > MOST_EDGE else 1.0


def spread_gutter(gray: np.ndarray) -> int | None:
    """Where a photo of two facing pages parts, or None: the column of least change near the middle of a wide image."""
    h, w = gray.shape
    if w < SPREAD_RATIO * h:
        return None
    width = min(w, SPREAD_WIDTH)
    small = resized(gray, width, max(2, round(h * width / w)))
    changes = (np.abs(np.diff(small, axis=0)) > TRANSITION).sum(axis=0).astype(np.float64)
    smooth = np.convolve(changes, np.ones(5), "same") / np.convolve(np.ones(width), np.ones(5), "same")
    low, high = int(0.4 * width), int(0.6 * width)
    at = low + int(np.argmin(smooth[low : high + 1]))
    left, right = smooth[:at].mean() if at else 0.0, smooth[at + 1 :].mean() if at + 1 < width else 0.0
    if min(left, right) < 2 or smooth[at] > 0.5 * min(left, right):
        return None
    return round(at * w / width)


def cropped(gray: np.ndarray, box: tuple[float, float, float, float], scale: float = 1.0) -> np.ndarray:
    """The part of an image in a box of another scale, with a pixel at least."""
    h, w = gray.shape[:2]
    x0, y0 = (min(max(0, int(v * scale)), n - 1) for v, n in ((box[0], w), (box[1], h)))
    x1, y1 = (min(max(lo + 1, int(np.ceil(v * scale))), n) for v, lo, n in ((box[2], x0, w), (box[3], y0, h)))
    return gray[y0:y1, x0:x1]


def png(gray: np.ndarray) -> bytes:
    """A gray image as a PNG file."""
    h, w = gray.shape

    def chunk(kind: bytes, data: bytes) -> bytes:
        return packing.pack(">I", len(data)) + kind + data + packing.pack(">I", zlib.crc32(kind + data))

    rows = np.concatenate([np.zeros((h, 1), np.uint8), gray.astype(np.uint8)], axis=1)  # each row says that it isn't filtered
    head = packing.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def halves(gray: np.ndarray) -> list[np.ndarray]:
    at = spread_gutter(gray)
    return [gray] if at is None else [gray[:, :at], gray[:, at:]]


def turned(gray: np.ndarray, quarters: int) -> np.ndarray:
    """Quarter turns clockwise."""
    return np.rot90(gray, -quarters)


def cell_edges(length: int, cell: int) -> np.ndarray:
    """Where cells begin; the last one may be smaller."""
    return np.arange(0, length, cell)


def _sampled_places(length: int, cell: int) -> tuple[np.ndarray, np.ndarray]:
    """Every second pixel of each cell, from its first on, and where each cell's begin among them."""
    at = np.arange(length)
    at = at[(at % cell) % 2 == 0]
    return at, np.searchsorted(at, cell_edges(length, cell))


def _sums(values: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    return np.add.reduceat(np.add.reduceat(values.astype(np.int64), rows, axis=0), columns, axis=1)


def _interpolated(grid: np.ndarray, cell: int, height: int, width: int) -> np.ndarray:
    """A value for each pixel between those of the cells' middles."""
    out = grid
    for axis, length in ((0, height), (1, width)):
        at = np.clip((np.arange(length) + 0.5) / cell - 0.5, 0, grid.shape[axis] - 1)
        low = np.floor(at).astype(int)
        high = np.minimum(low + 1, grid.shape[axis] - 1)
        part = (at - low).reshape((-1, 1) if axis == 0 else (1, -1))
        out = np.take(out, low, axis) * (1 - part) + np.take(out, high, axis) * part
    return out


def paper_brightness(gray: np.ndarray, cell: int) -> np.ndarray:
    """For each cell the least value that PAPER_QUANTILE of its sampled pixels don't exceed."""
    h, w = gray.shape
    ys, xs = cell_edges(h, cell), cell_edges(w, cell)
    out = np.empty((len(ys), len(xs)))
    for r, y in enumerate(ys):
        for c, x in enumerate(xs):
            values = np.sort(gray[y : y + cell : 2, x : x + cell : 2], axis=None)
            out[r, c] = values[max(0, int(np.ceil(len(values) * PAPER_QUANTILE)) - 1)]
    return out


def flattened(gray: np.ndarray) -> np.ndarray:
    """The page with even paper: brightness is divided by that of the paper around."""
    h, w = gray.shape
    cell = max(16, int(max(h, w) / CELL_PART + 0.5))
    paper = paper_brightness(gray, cell)
    rows, columns = paper.shape

    def around(values: np.ndarray) -> np.ndarray:
        return np.stack([np.pad(values, 1)[a : a + rows, b : b + columns] for a in range(3) for b in range(3)])

    neighbours = around(np.ones_like(paper)).sum(axis=0)
    for _ in range(2):
        near = around(paper)
        paper = 0.5 * near.max(axis=0) + 0.5 * near.sum(axis=0) / neighbours
    paper = _interpolated(paper, cell, h, w)
    even = np.minimum(255, np.round(gray * 255.0 / np.maximum(paper, 1)))
    return np.where(paper < DARK_PAPER, gray, even).astype(np.uint8)


def stretched(gray: np.ndarray) -> np.ndarray:
    """Darkest ink drawn down to black, unless it is black already or nothing is dark."""
    sample = np.sort(gray.reshape(-1)[::STRETCH_STEP])
    low = int(sample[max(0, int(np.ceil(STRETCH_PART * len(sample))) - 1)]) if len(sample) else 0
    if low <= 5 or low >= 200:
        return gray
    return np.clip(np.round((gray.astype(np.float64) - low) * (255 / (255 - low))), 0, 255).astype(np.uint8)


def figure_boxes(gray: np.ndarray, text: list[tuple[float, float, float, float]], line_height: float) -> list[tuple[float, float, float, float]]:
    """Boxes (x0, y0, x1, y1) of connected areas with ink or tone that no text explains, as large as figures are, with half a cell of margin."""
    h, w = gray.shape
    if not h or not w:
        return []
    cell = max(8, int(min(h, w) / FIGURE_CELLS + 0.5))
    (ys, row_starts), (xs, column_starts) = _sampled_places(h, cell), _sampled_places(w, cell)
    seen = gray[np.ix_(ys, xs)]
    n = _sums(np.ones_like(seen), row_starts, column_starts)
    dark, mid = _sums(seen < 128, row_starts, column_starts) / n, _sums((seen >= 128) & (seen < 215), row_starts, column_starts) / n
    rows, columns = n.shape
    covered = np.zeros((rows, columns), bool)
    pad = 0.4 * line_height
    for x0, y0, x1, y1 in text:
        a, b = (slice(max(0, int((lo - pad) // cell)), max(0, int((hi + pad) // cell) + 1)) for lo, hi in ((y0, y1), (x0, x1)))
        covered[a, b] = True
    apart = [(k < EDGE * size) | (k > size * (1 - EDGE)) for k, size in ((np.arange(rows), rows), (np.arange(columns), columns))]
    found = ((dark > INK) | (mid > TONE)) & ~covered & ~apart[0][:, None] & ~apart[1][None, :]
    near = sum(np.pad(found.astype(int), 2)[a : a + rows, b : b + columns] for a in range(5) for b in range(5))
    full = found | ((near >= CLOSED) & ~covered)
    out = []
    for area in _connected(full):
        y0, x0 = area.min(axis=0)
        y1, x1 = area.max(axis=0) + 1
        wide, high = int(x1 - x0), int(y1 - y0)
        if wide >= 0.12 * columns and high >= 0.06 * rows and wide * high >= 0.025 * columns * rows and len(area) >= 0.3 * wide * high:
            out.append((max(0.0, (x0 - 0.5) * cell), max(0.0, (y0 - 0.5) * cell), min(float(w), (x1 + 0.5) * cell), min(float(h), (y1 + 0.5) * cell)))
    return out


def _connected(full: np.ndarray) -> list[np.ndarray]:
    """Cells of each area connected by edges."""
    left, out = full.copy(), []
    for start in zip(*np.nonzero(full), strict=True):
        if not left[start]:
            continue
        left[start] = False
        area, stack = [], [start]
        while stack:
            y, x = stack.pop()
            area.append((y, x))
            for p in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
                if 0 <= p[0] < full.shape[0] and 0 <= p[1] < full.shape[1] and left[p]:
                    left[p] = False
                    stack.append(p)
        out.append(np.array(area))
    return out


def added_boxes(found: list[tuple], blocks: list[tuple], width: float, height: float) -> list[tuple]:
    """Figure boxes with a recognizer's image blocks that are large enough and overlap none so far."""
    out = list(found)
    for b in blocks:
        area = (b[2] - b[0]) * (b[3] - b[1])

        def shared(o: tuple, b: tuple = b, area: float = area) -> float:
            w, h = min(o[2], b[2]) - max(o[0], b[0]), min(o[3], b[3]) - max(o[1], b[1])
            least = min(area, (o[2] - o[0]) * (o[3] - o[1]))
            return w * h / least if w > 0 and h > 0 and least > 0 else 0.0

        if area > 0.03 * width * height and all(shared(o) <= 0.5 for o in out):
            out.append(b)
    return out


GRAY = "struct<width:int,height:int,data:binary>"


def _unpacked(frame: pd.DataFrame) -> list[np.ndarray]:
    return [np.frombuffer(d, np.uint8).reshape(h, w) for w, h, d in zip(frame["width"], frame["height"], frame["data"], strict=True)]


def gray_image(image: Column) -> Column:
    """The gray image (GRAY) of a column of Spark's image source."""

    def convert(frame: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for w, h, n, d in zip(frame["width"], frame["height"], frame["nChannels"], frame["data"], strict=True):
            x = np.frombuffer(d, np.uint8).reshape(h, w, n)
            rows.append((w, h, (x[..., 0] if n == 1 else luma(x)).tobytes()))
        return pd.DataFrame(rows, columns=["width", "height", "data"])

    return F.pandas_udf(convert, _gray_type())(image)


def _gray_type() -> StructType:
    return StructType().add("width", IntegerType()).add("height", IntegerType()).add("data", BinaryType())


def prepared(gray: Column) -> Column:
    """A gray image scaled, evened and stretched for recognition."""

    def convert(frame: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for x in _unpacked(frame):
            scale = recognition_scale(x.shape[1], x.shape[0])
            if scale != 1:
                x = np.clip(np.round(resized(x, round(x.shape[1] * scale), round(x.shape[0] * scale))), 0, 255).astype(np.uint8)
            x = stretched(flattened(x))
            rows.append((x.shape[1], x.shape[0], x.tobytes()))
        return pd.DataFrame(rows, columns=["width", "height", "data"])

    return F.pandas_udf(convert, _gray_type())(gray)


def split_spreads(photos: DataFrame) -> DataFrame:
    """photos (source_id, gray) as pages (source_id, part, gray): two for a photo of facing pages."""
    schema = struct(f"source_id string, part int, gray {GRAY}")

    def work(frames):
        for frame in frames:
            rows = []
            for key, g in zip(frame["source_id"], frame["gray"], strict=True):
                x = np.frombuffer(g["data"], np.uint8).reshape(g["height"], g["width"])
                rows += [(key, k, {"width": p.shape[1], "height": p.shape[0], "data": np.ascontiguousarray(p).tobytes()}) for k, p in enumerate(halves(x))]
            yield pd.DataFrame(rows, columns=["source_id", "part", "gray"])

    return photos.select("source_id", "gray").mapInPandas(work, schema)


def figure_images(pages: DataFrame, boxes: DataFrame, scale: float = 1.0) -> DataFrame:
    """The parts of page images that figures show, as rows of IMAGES with id "doc_id:page:fig_no". pages: doc_id, page, gray; boxes: doc_id, page, fig_no, x0, y0, x1, y1, in
    pixels of an image of another scale."""

    def work(frames):
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                x = np.frombuffer(r.gray["data"], np.uint8).reshape(r.gray["height"], r.gray["width"])
                part = cropped(x, (r.x0, r.y0, r.x1, r.y1), scale)
                rows.append((f"{r.doc_id}:{r.page}:{r.fig_no}", png(part), "image/png", part.shape[1], part.shape[0]))
            yield pd.DataFrame(rows, columns=["id", "data", "mime", "width", "height"])

    return pages.select("doc_id", "page", "gray").join(boxes.select("doc_id", "page", "fig_no", "x0", "y0", "x1", "y1"), ["doc_id", "page"]).mapInPandas(work, struct(IMAGES))


ship(__name__)
