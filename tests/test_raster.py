import random
import struct
import zlib

import numpy as np
import pytest

from quire.operators import raster


def picture(seed, h, w):
    """Uneven paper with lines of ink, a gray area and a drawing."""
    rng = random.Random(seed)
    page = np.fromfunction(lambda y, x: 150 + 90 * x / w - 30 * y / h, (h, w))
    for _ in range(60):
        y, x = rng.randrange(h), rng.randrange(w)
        page[y : y + rng.randint(1, 6), x : x + rng.randint(5, 60)] = rng.randint(0, 120)
    y, x = int(0.4 * h), int(0.3 * w)
    page[y : y + h // 5, x : x + w // 3] = 170
    page[y : y + h // 5 : 7, x : x + w // 2] = 20
    return page.astype(np.uint8)


def slow_flattened(gray):
    """Pixel by pixel."""
    h, w = gray.shape
    cell = max(16, int(max(h, w) / 60 + 0.5))
    grid = {}
    for gy in range(-(-h // cell)):
        for gx in range(-(-w // cell)):
            values = sorted(int(gray[y, x]) for y in range(gy * cell, min(h, gy * cell + cell), 2) for x in range(gx * cell, min(w, gx * cell + cell), 2))
            left = len(values) * 0.9
            for v in values:
                left -= 1
                if left <= 0:
                    break
            grid[gy, gx] = float(v)
    for _ in range(2):
        near = {p: [grid[q] for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (q := (p[0] + dy, p[1] + dx)) in grid] for p in grid}
        grid = {p: 0.5 * max(v) + 0.5 * sum(v) / len(v) for p, v in near.items()}
    last_y, last_x = max(grid)
    out = np.empty_like(gray)
    for y in range(h):
        fy = min(last_y, max(0, (y + 0.5) / cell - 0.5))
        for x in range(w):
            fx = min(last_x, max(0, (x + 0.5) / cell - 0.5))
            a, b = int(fy), int(fx)
            c, d = min(last_y, a + 1), min(last_x, b + 1)
            paper = (grid[a, b] * (1 - fx + b) + grid[a, d] * (fx - b)) * (1 - fy + a) + (grid[c, b] * (1 - fx + b) + grid[c, d] * (fx - b)) * (fy - a)
            out[y, x] = gray[y, x] if paper < 40 else min(255, round(int(gray[y, x]) * 255 / paper))
    return out


def slow_boxes(gray, text, line_height):
    """Cell by cell."""
    h, w = gray.shape
    cell = max(8, int(min(h, w) / 70 + 0.5))
    rows, columns = -(-h // cell), -(-w // cell)
    every = [(r, c) for r in range(rows) for c in range(columns)]
    pad = 0.4 * line_height
    covered = {(r, c) for r, c in every for x0, y0, x1, y1 in text if (x0 - pad) // cell <= c <= (x1 + pad) // cell and (y0 - pad) // cell <= r <= (y1 + pad) // cell}
    marked = set()
    for r, c in every:
        if c < columns * 0.04 or c > columns * 0.96 or r < rows * 0.04 or r > rows * 0.96 or (r, c) in covered:
            continue
        seen = [int(gray[y, x]) for y in range(r * cell, min(h, r * cell + cell), 2) for x in range(c * cell, min(w, c * cell + cell), 2)]
        if sum(v < 128 for v in seen) > 0.03 * len(seen) or sum(128 <= v < 215 for v in seen) > 0.25 * len(seen):
            marked.add((r, c))
    full = marked | {(r, c) for r, c in every if (r, c) not in covered and sum((r + a, c + b) in marked for a in range(-2, 3) for b in range(-2, 3)) >= 6}
    out, left = [], set(full)
    while left:
        area, stack = set(), [left.pop()]
        while stack:
            r, c = stack.pop()
            area.add((r, c))
            for p in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                if p in left:
                    left.remove(p)
                    stack.append(p)
        r0, r1, c0, c1 = min(r for r, _ in area), max(r for r, _ in area), min(c for _, c in area), max(c for _, c in area)
        wide, high = c1 - c0 + 1, r1 - r0 + 1
        if wide >= 0.12 * columns and high >= 0.06 * rows and wide * high >= 0.025 * rows * columns and len(area) >= 0.3 * wide * high:
            out.append((max(0, (c0 - 0.5) * cell), max(0, (r0 - 0.5) * cell), min(w, (c1 + 1.5) * cell), min(h, (r1 + 1.5) * cell)))
    return sorted(out)


@pytest.mark.parametrize(("seed", "h", "w"), [(1, 203, 151), (2, 96, 310), (3, 64, 64)])
def test_flattened_equals_a_slow_loop(seed, h, w):
    gray = picture(seed, h, w)
    assert np.abs(raster.flattened(gray).astype(int) - slow_flattened(gray).astype(int)).max() <= 1


@pytest.mark.parametrize(("seed", "h", "w"), [(1, 603, 451), (2, 400, 810), (3, 317, 645)])
def test_figure_boxes_equal_a_slow_loop(seed, h, w):
    gray = picture(seed, h, w)
    text = [(0.25 * w, 0.45 * h, 0.5 * w, 0.47 * h), (10.0, 10.0, 0.9 * w, 30.0)]
    for lines in ([], text):
        assert sorted(raster.figure_boxes(gray, lines, 12.0)) == slow_boxes(gray, lines, 12.0)
    assert raster.figure_boxes(gray, [], 12.0)


def test_darkest_hundredth_becomes_black():
    gray = np.arange(300, dtype=np.uint8).reshape(1, -1) % 200 + 50
    sample, low = sorted(gray.reshape(-1)[::3].tolist()), None
    for k, v in enumerate(sample, 1):
        if k >= 0.01 * len(sample):
            low = v
            break
    want = [0 if v <= low else min(255, round((v - low) * (255 / (255 - low)))) for v in gray[0].tolist()]
    assert raster.stretched(gray)[0].tolist() == want


def test_png_round_trip():
    gray = picture(4, 33, 57)
    data = raster.png(gray)
    at, parts = 8, {}
    while at < len(data):
        n = struct.unpack(">I", data[at : at + 4])[0]
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        assert struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] == zlib.crc32(kind + body)
        parts[kind] = body
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(parts[b"IDAT"]), np.uint8).reshape(33, 58)
    assert struct.unpack(">II", parts[b"IHDR"][:8]) == (57, 33) and (rows[:, 1:] == gray).all() and not rows[:, 0].any()


def test_figures_are_cut_and_stored(spark):
    gray = picture(5, 60, 80)
    pages = spark.createDataFrame([("d", 0, (80, 60, bytearray(gray.tobytes())))], f"doc_id string, page int, gray {raster.GRAY}")
    boxes = spark.createDataFrame([("d", 0, 0, 5.0, 6.0, 15.0, 26.0), ("d", 1, 0, 0.0, 0.0, 1.0, 1.0)], "doc_id string, page int, fig_no int, x0 double, y0 double, x1 double, y1 double")
    rows = raster.figure_images(pages, boxes, scale=2.0).collect()
    assert [(r["id"], r["mime"], r["width"], r["height"]) for r in rows] == [("d:0:0", "image/png", 20, 40)]
    assert bytes(rows[0]["data"]) == raster.png(gray[12:52, 10:30])
