"""Builders of synthetic page layouts: 612 x 792, body size 11 at pitch 14 from y 100."""

from pyspark.sql import functions as F

from quire.schemas import FIGURES, LINES, PAGE_LAYOUTS


def line(text, y0, *, size=11.0, x0=72.0, x1=540.0, y1=None, conf=None, para=None, spans=None, b=False):
    spans = spans or [(text, False, False, b)]
    return {"spans": spans, "x0": float(x0), "y0": float(y0), "x1": float(x1), "y1": float(y0 + size if y1 is None else y1), "size": float(size), "conf": conf, "para": para}


def body(texts, start=100, *, new=(0,), last=300.0):
    """Lines at pitch 14; those in `new` are indented, the one before each and the last are short."""
    out = []
    for k, text in enumerate(texts):
        ends = k + 1 == len(texts) or k + 1 in new
        out.append(line(text, start + 14 * k, x0=90.0 if k in new else 72.0, x1=last if ends else 540.0))
    return out


def tables(spark, pages, figures=(), doc="d", labels=None, source="text", confidence=None):
    lines = [(doc, p, k, x["spans"], x["x0"], x["y0"], x["x1"], x["y1"], x["size"], x["conf"], x["para"]) for p, own in enumerate(pages) for k, x in enumerate(own)]
    layouts = [(doc, p, 612.0, 792.0, labels[p] if labels else None, source, confidence, None) for p in range(len(pages))]
    return spark.createDataFrame(lines, LINES), spark.createDataFrame(layouts, PAGE_LAYOUTS), spark.createDataFrame(list(figures), FIGURES)


def texts(blocks):
    """(kind, level, text) of blocks in order; page breaks as |n|, references as ^id^."""

    def one(c):
        return c["text"] if c["t"] == "text" else f"|{c['page']}|" if c["t"] == "pb" else f"^{c['note']}^"

    return [(b["kind"], b["level"], "".join(map(one, b["content"] or []))) for b in blocks.orderBy(F.col("block_no")).collect()]
