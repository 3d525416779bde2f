"""Figures that compete for captions: a plain loop against layout.captions()."""

import random

from pyspark.sql import functions as F

from quire.operators.layout import captions

LINE = "struct<text:string,sup:boolean,i:boolean,b:boolean>"


def loop(figures, lines, body):
    used, out = set(), {}
    like = lambda t: t.startswith(("Figure 1", "Table 2"))
    for no, y0, y1 in figures:
        near = sorted((abs(a - y1), n, a) for n, t, a, b, _ in lines if n not in used and like(t) and (abs(a - y1) < 4 * body or abs(y0 - b) < 4 * body))
        if not near:
            out[no] = []
            continue
        first = next(x for x in lines if x[0] == near[0][1])
        held = [first]
        for line in sorted((x for x in lines if x[2] > first[2]), key=lambda x: (x[2], x[0])):
            if len(held) == 4 or line[2] - held[-1][3] >= 0.6 * body or abs(line[4] - first[4]) >= 3 * body:
                break
            held.append(line)
        used |= {x[0] for x in held}
        out[no] = [x[0] for x in held]
    return out


def test_captions_equal_the_loop(spark):
    rng, figures, lines, want = random.Random(9), [], [], {}
    for page in range(300):
        own = [(n, rng.choice(["Figure 1. It", "Table 2 is", "plain", "plain"]), y := float(rng.randrange(100, 400, 7)), y + rng.choice([6.0, 11.0]), float(rng.choice([72, 80, 320]))) for n in range(rng.randint(0, 14))]
        boxes = sorted((k, y := float(rng.randrange(100, 380)), y + rng.randrange(5, 60)) for k in range(rng.randint(0, 4)))
        figures += [("d", page, k, a, b) for k, a, b in boxes]
        lines += [("d", page, n, [(t, False, False, False)], x, a, b) for n, t, a, b, x in own]
        if any(t != "plain" for _, t, *_ in own):
            want |= {(page, k): held for k, held in loop(boxes, own, 11.0).items()}
    df = captions(
        spark.createDataFrame(figures, "doc_id string, page int, item_no int, y0 double, y1 double"),
        spark.createDataFrame(lines, f"doc_id string, page int, line_no int, spans array<{LINE}>, x0 double, y0 double, y1 double"),
        spark.createDataFrame([("d", 11.0)], "doc_id string, body double"),
    )
    got = {(r["page"], r["item_no"]): r["caption_lines"] for r in df.collect()}
    assert got == want and sum(map(bool, want.values())) > 100
    assert df.where(F.size("caption_lines") != F.size("caption_texts")).count() == 0
