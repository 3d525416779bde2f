"""From positioned lines to reading order: noise, running heads, page labels, body size, footnotes, columns. All native.

Tables are those of quire.schemas. Lines of a page are in order of their top edge, then their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import stats
from quire.functions.inline import bound
from quire.functions.text import CAPTION, NOTE_START, bigrams, dice, line_text, norm_header, page_number, trimmed
from quire.saving import saved

PAGE = ["doc_id", "page"]

#: Thresholds of the layout rules.
NOISE_CONFIDENCE, NOISE_LENGTH = 35, 3
ZONE_OF_PAGE, ZONE_OF_CONTENT, OUTER_PART = 0.10, 0.07, 0.25
HEAD_LENGTH, APART_LENGTH, APART_LINES, APART_SIZE, APART_GAP = 120, 70, 6, 0.9, 1.2
REPEAT_LENGTH, REPEAT_SIMILARITY, REPEAT_PAGES = 3, 0.75, 0.25
TRUSTED_PART = 0.4
NOTE_SIZE, NOTE_PART, NOTE_TOP = 0.88, 0.5, 0.45
GUTTER_FROM, GUTTER_TO, GUTTER_STEP, GUTTER_SLACK = 0.35, 0.65, 0.01, 2
GUTTER_LINES, GUTTER_CROSSED, GUTTER_SIDE = 8, 0.15, 0.2
CAPTION_REACH, CAPTION_GAP, CAPTION_SHIFT, CAPTION_LINES = 4.0, 0.6, 3.0, 4


def noise_filter(lines: DataFrame) -> DataFrame:
    """Without blank lines and short ones that a recognizer wasn't sure of."""
    text = trimmed(line_text(F.col("spans")))
    doubtful = F.coalesce(F.col("conf") < NOISE_CONFIDENCE, F.lit(False)) & (F.length(text) <= NOISE_LENGTH)
    return lines.where((text != "") & ~doubtful)


def page_extents(lines: DataFrame) -> DataFrame:
    return lines.groupBy(*PAGE).agg(F.min("y0").alias("top"), F.max("y1").alias("bottom"), F.median("size").alias("median_size"))


def header_marks(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """lines with what tells running heads: `candidate` (one of the outermost two lines at either end of the page, in its head or foot zone), top, place, apart, norm, number."""
    whole = Window.partitionBy(*PAGE)
    down = whole.orderBy("y0", "line_no")
    up = whole.orderBy(F.desc("y0"), F.desc("line_no"))
    text = line_text(F.col("spans"))
    placed = lines.join(pages.select(*PAGE, "height"), PAGE).withColumns({
        "_text": text, "place": F.row_number().over(down), "_from_end": F.row_number().over(up), "_n": F.count("*").over(whole),
        "_top_edge": F.min("y0").over(whole), "_bottom_edge": F.max("y1").over(whole), "_page_size": F.median("size").over(whole),
        "_below": F.lead("y0").over(down) - F.col("y1"), "_above": F.col("y0") - F.lag("y1").over(down),
    })
    top = F.col("place") <= 2
    at_end = top | ((F.col("_from_end") <= 2) & ((F.col("place") > 2) | (F.col("_n") > 4)))
    centre = (F.col("y0") + F.col("y1")) / 2
    zone = F.greatest(ZONE_OF_PAGE * F.col("height"), ZONE_OF_CONTENT * F.greatest(F.lit(1.0), F.col("_bottom_edge") - F.col("_top_edge")))
    in_zone = F.when(top, (centre - F.col("_top_edge") < zone) & (centre < OUTER_PART * F.col("height"))).otherwise(
        (F.col("_bottom_edge") - centre < zone) & (centre > (1 - OUTER_PART) * F.col("height"))
    )
    gap = F.coalesce(F.when(top, F.col("_below")).otherwise(F.col("_above")), F.lit(float("inf")))
    apart = (
        F.when(top, F.col("place") == 1).otherwise((F.col("_from_end") == 1) & ~F.col("_text").rlike("^(?:" + NOTE_START + ")"))
        & (F.col("_n") >= APART_LINES)
        & (F.col("size") <= APART_SIZE * F.col("_page_size"))
        & (F.length(trimmed(F.col("_text"))) < APART_LENGTH)
        & (gap >= APART_GAP * F.col("size"))
    )
    marked = placed.withColumn("candidate", F.coalesce(at_end & (F.length("_text") <= HEAD_LENGTH) & in_zone, F.lit(False)))
    only = lambda c: F.when(F.col("candidate"), c)
    marked = marked.withColumns({"top": only(top), "apart": only(apart), "norm": only(norm_header(F.col("_text"))), "number": only(page_number(F.col("_text")))})
    return marked.select(*lines.columns, "height", "candidate", "top", "place", "apart", "norm", "number")


def header_candidates(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """The outermost two lines at either end of each page that lie in its head or foot zone."""
    return header_marks(lines, pages).where("candidate").select(*PAGE, "line_no", line_text(F.col("spans")).alias("text"), "top", "place", "apart", "norm", "number")


def alike_heads(norms: DataFrame) -> DataFrame:
    """doc_id, top, norm, other: all pairs of different norms (doc_id, top, norm) of similarity REPEAT_SIMILARITY or more, each pair in both orders.

    An inverted index of numbered bigrams, the rarest of a document first. A norm of n bigrams has at least REPEAT_SIMILARITY / 2 of its own and its partner's in common with it, and the
    partner has no fewer than `shorter` times n; so both have a common bigram among the first n - ceil(least) + 1, and only norms that meet in one are compared.
    """
    half = REPEAT_SIMILARITY / 2
    shorter = half / (1 - half)
    keys = ["doc_id", "top"]
    grams = norms.select(*keys, "norm", F.explode(bigrams(F.col("norm"))).alias("gram"))
    told = grams.withColumns({"_times": F.count("*").over(Window.partitionBy(*keys, "gram")), "_n": F.length("norm") - 1})
    place = F.row_number().over(Window.partitionBy(*keys, "norm").orderBy("_times", "gram"))
    first = told.withColumn("_place", place).where((F.col("_times") > 1) & (F.col("_place") <= F.col("_n") - F.ceil(half * (1 + shorter) * F.col("_n") - 1e-9) + 1))
    a, b = first.select(*keys, "gram", "norm", "_n"), first.select(*keys, "gram", F.col("norm").alias("other"), F.col("_n").alias("_m"))
    near = a.join(b, [*keys, "gram"]).where((F.col("norm") < F.col("other")) & (2 * F.least("_n", "_m") >= REPEAT_SIMILARITY * (F.col("_n") + F.col("_m"))))
    pairs = near.select(*keys, "norm", "other").distinct().where(dice(F.col("norm"), F.col("other")) >= REPEAT_SIMILARITY)
    return pairs.union(pairs.select(*keys, F.col("other").alias("norm"), F.col("norm").alias("other")))


def repeated_heads(candidates: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, top, norm of heads that stand, about alike, on enough pages.

    Different norms of a document are compared, not their occurrences, and only those that share rare bigrams.
    """
    needed = pages.groupBy("doc_id").agg(F.count("*").alias("_pages"), F.greatest(F.lit(2), F.ceil(REPEAT_PAGES * F.count("*"))).alias("needed"))
    on = candidates.where(F.length("norm") >= REPEAT_LENGTH).select("doc_id", "top", "norm", "page").distinct()
    on = on.join(needed.where("_pages >= needed"), "doc_id", "left_semi")  # no head stands on two pages of one
    others = alike_heads(on.select("doc_id", "top", "norm").distinct()).join(on.withColumnRenamed("norm", "other"), ["doc_id", "top", "other"])
    times = on.unionByName(others.drop("other")).groupBy("doc_id", "top", "norm").agg(F.countDistinct("page").alias("on_pages"))
    return times.join(needed, "doc_id").where("on_pages >= needed").select("doc_id", "top", "norm")


def running_marks(marked: DataFrame, heads: DataFrame) -> DataFrame:
    """header_marks() with `running`: whether a line is a running head or foot. heads: repeated_heads() of them."""
    met = marked.where("candidate").select(*PAGE, "top", "norm").join(heads, ["doc_id", "top", "norm"]).groupBy(*PAGE).agg(F.collect_set(F.struct("top", "norm")).alias("_heads"))
    repeated = F.coalesce(F.array_contains("_heads", F.struct("top", "norm")), F.lit(False))
    gone = (F.col("number").isNotNull() & (F.col("norm") == "")) | F.col("apart") | repeated
    told = marked.join(met, PAGE, "left").withColumn("running", F.coalesce(F.col("candidate") & gone, F.lit(False)))
    return told.select(*marked.columns, "running")


def running_lines(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, page, line_no of running heads and feet, with the page number each one shows and its order on the page."""
    marked = header_marks(lines, pages)
    candidates = saved(marked.where("candidate").select(*PAGE, "line_no", "candidate", "top", "place", "apart", "norm", "number"))
    return shown_numbers(running_marks(candidates, repeated_heads(candidates, pages)))


def shown_numbers(marked: DataFrame) -> DataFrame:
    return marked.where("running").select(*PAGE, "line_no", "number", F.when(F.col("top"), 0).otherwise(1).alias("end"), "place")


def page_labels(pages: DataFrame, running: DataFrame) -> DataFrame:
    """pages with label: the file's own unless they only count pages; else what running lines show, made consistent; '' if unknown."""
    shown = running.where(F.col("number").isNotNull()).groupBy(*PAGE).agg(F.min_by("number", F.struct("end", "place")).alias("detected"))
    known = pages.join(shown, PAGE, "left")
    whole = Window.partitionBy("doc_id")
    own = F.coalesce("pdf_label", F.lit("")) != ""
    telling = F.bool_or(own & (F.col("pdf_label") != (F.col("page") + 1).cast("string"))).over(whole)
    arabic = F.col("detected").rlike("^[0-9]+$")
    offsets = known.where(arabic).select("doc_id", "page", (F.col("detected").try_cast("int") - F.col("page")).alias("offset"))
    best = stats.first_seen_mode(offsets, ["doc_id"], "offset", "page")
    counted = known.withColumns({"_telling": telling, "_pages": F.count("*").over(whole)}).join(best, "doc_id", "left")
    trusted = ((F.col("times") >= 2) | ((F.col("total") == 1) & (F.col("_pages") <= 2))) & (F.col("times") >= TRUSTED_PART * F.col("total"))
    number = F.col("page") + F.col("offset")
    repaired = F.when(~arabic, F.col("detected")).when(F.coalesce(trusted, F.lit(False)) & (number >= 1), number.cast("string")).otherwise(F.coalesce("detected", F.lit("")))
    label = F.when(F.col("_telling"), F.coalesce("pdf_label", F.lit(""))).otherwise(repaired)
    return counted.select(*(c for c in pages.columns if c != "label"), label.alias("label"))


def page_infos(labelled: DataFrame) -> DataFrame:
    return labelled.select(*PAGE, "label", stats.half_up(F.col("confidence")).cast("int").alias("confidence"), "source", "preview")


def line_weight(spans: Column) -> Column:
    """What a line counts for its document's body size."""
    return F.least(F.lit(80), F.ceil(F.length(line_text(spans)) / 10)).cast("int")


def note_lead(spans: Column) -> Column:
    """What a note's first line begins with: its marker and what stands before the text; '' for others."""
    return F.regexp_extract(line_text(spans), "^(?:" + NOTE_START + ")", 0)


def body_size(lines: DataFrame) -> DataFrame:
    """doc_id, body: the median size of each document's lines, long lines counting more (by `weight`, if the lines have it)."""
    weight = F.col("weight") if "weight" in lines.columns else line_weight(F.col("spans"))
    return lines.groupBy("doc_id").agg(stats.weighted_median(F.col("size"), weight).alias("body"))


def strip_prefix(spans: Column, chars: Column) -> Column:
    """spans without their first chars characters; a span may be cut in two."""

    def step(state: Column, s: Column) -> Column:
        n = F.length(s["text"])
        cut = s.withField("text", F.substring(s["text"], state["left"] + 1, n))
        gone = (state["left"] > 0) & (state["left"] >= n)
        return F.struct(F.greatest(state["left"] - n, F.lit(0)).alias("left"), F.when(gone, state["out"]).otherwise(F.concat(state["out"], F.array(cut))).alias("out"))

    start = F.struct(chars.cast("int").alias("left"), F.filter(spans, lambda _: F.lit(False)).alias("out"))
    return F.aggregate(spans, start, step, lambda s: s["out"])


def note_marks(lines: DataFrame, body: DataFrame, height: str = "height") -> DataFrame:
    """lines (with their page's `height`) with body, and on the notes at the foot of each page note_no (from 1), marker and spans without it.

    The notes are the page's last lines in small type, from the first that begins with a marker on. Sizes meet pages, not lines, and what a line begins with is asked before lines are
    dealt (`lead`, if they have it), so that texts are dealt once.
    """
    if "lead" not in lines.columns:
        return note_marks(lines.withColumn("lead", note_lead(F.col("spans"))), body, height).drop("lead")
    whole = Window.partitionBy(*PAGE)
    up = whole.orderBy(F.desc("y0"), F.desc("line_no")).rowsBetween(Window.unboundedPreceding, 0)
    down = whole.orderBy("y0", "line_no").rowsBetween(Window.unboundedPreceding, 0)
    sized = lines.join(lines.select(*PAGE).distinct().join(body, "doc_id"), PAGE)
    small = F.bool_and(F.col("size") <= NOTE_SIZE * F.col("body")).over(up)
    tail = sized.withColumns({"_n": F.count("*").over(whole), "_tail": small & (F.col("body") > 0)})
    tail = tail.withColumn("_lead", F.when(F.col("_tail") & (F.col("_n") >= 3), F.col("lead")))
    numbered = tail.withColumn("_no", F.sum(F.when(F.col("_lead") != "", 1).otherwise(0)).over(down))
    member = F.col("_lead").isNotNull() & (F.col("_no") > 0)
    blocks = numbered.withColumns({"_member": member, "_block": F.sum(member.cast("int")).over(whole), "_first": F.min(F.when(member, F.col("y0"))).over(whole)})
    sound = F.col("_member") & (F.col("_block") <= NOTE_PART * F.col("_n")) & (F.col("_first") >= NOTE_TOP * F.col(height))
    told = blocks.withColumn("note_no", F.when(sound, F.col("_no")))
    begun = F.regexp_extract(F.concat("lead", F.lit("x")), "^(?:" + NOTE_START + ")", 1)  # a text follows what a note begins with
    marker = F.first(F.when(F.col("note_no").isNotNull(), begun)).over(Window.partitionBy(*PAGE, "note_no").orderBy("y0", "line_no"))
    spans = F.when(F.col("note_no").isNotNull() & (F.col("_lead") != ""), strip_prefix(F.col("spans"), F.length("_lead"))).otherwise(F.col("spans"))
    return told.withColumns({"marker": marker, "spans": spans}).select(*lines.columns, "body", "note_no", "marker")


def footnotes(lines: DataFrame, pages: DataFrame, body: DataFrame) -> DataFrame:
    """Lines of the notes at the foot of each page, with note_no (from 1), marker and spans without it."""
    marked = note_marks(lines.join(pages.select(*PAGE, "height"), PAGE), body)
    return marked.where(F.col("note_no").isNotNull()).select(*lines.columns, "note_no", "marker")


def _fractions() -> list[float]:
    out, f = [], GUTTER_FROM
    while f <= GUTTER_TO:
        out.append(f)
        f += GUTTER_STEP
    return out


def gutters(lines: DataFrame) -> DataFrame:
    """doc_id, page, left, right, gutter: where the white space between two columns is; null for one column."""
    boxes = lines.groupBy(*PAGE).agg(F.collect_list(F.struct("x0", "x1")).alias("boxes"), F.min("x0").alias("left"), F.max("x1").alias("right"), F.count("*").alias("n"))
    places = F.transform(F.array(*map(F.lit, _fractions())), lambda f: F.col("left") + f * F.greatest(F.lit(1.0), F.col("right") - F.col("left")))

    def count(test) -> Column:
        return F.size(F.filter("boxes", test))

    crossed = F.transform(places, lambda x, k: F.struct(count(lambda b: (b["x0"] < x - GUTTER_SLACK) & (b["x1"] > x + GUTTER_SLACK)).alias("n"), k.alias("k"), x.alias("x")))
    found = boxes.withColumn("best", F.array_min(crossed))
    x = F.col("best.x")
    sound = (
        (F.col("n") >= GUTTER_LINES)
        & (F.col("best.n") <= GUTTER_CROSSED * F.col("n"))
        & (count(lambda b: b["x1"] <= x + GUTTER_SLACK) >= GUTTER_SIDE * F.col("n"))
        & (count(lambda b: b["x0"] >= x - GUTTER_SLACK) >= GUTTER_SIDE * F.col("n"))
    )
    return found.select(*PAGE, "left", "right", F.when(sound, x).alias("gutter"))


def reading_order(lines: DataFrame, figures: DataFrame) -> DataFrame:
    """Lines and figures of each page as items in reading order (item_no from 1), with their column: 0 across the page, 1 left, 2 right.

    Items across the page part it into bands; in each, the left column comes first.
    """
    items = lines.withColumns({"kind": F.lit("line"), "no": F.col("line_no")}).unionByName(figures.withColumns({"kind": F.lit("figure"), "no": F.col("fig_no")}), allowMissingColumns=True)
    split = items.join(gutters(lines), PAGE, "left")
    col = F.when(F.col("gutter").isNull(), 0).when(F.col("x1") <= F.col("gutter") + GUTTER_SLACK, 1).when(F.col("x0") >= F.col("gutter") - GUTTER_SLACK, 2).otherwise(0)
    down = Window.partitionBy(*PAGE).orderBy("y0", F.desc("kind"), "no")
    banded = split.withColumn("col", col).withColumn("band", F.sum(F.when(F.col("col") == 0, 1).otherwise(0)).over(down.rowsBetween(Window.unboundedPreceding, 0)))
    read = Window.partitionBy(*PAGE).orderBy("band", "col", "y0", F.desc("kind"), "no")
    return banded.withColumn("item_no", F.row_number().over(read))


def column_stats(items: DataFrame, body: DataFrame | None = None) -> DataFrame:
    """items with their column's usual left and right edge, width and line pitch. body: the documents' body sizes, if the items don't have them."""
    column = Window.partitionBy(*PAGE, "col")
    is_line = F.col("kind") == "line"
    in_line = Window.partitionBy(*PAGE, "col", "kind").orderBy("item_no")
    step = F.when(is_line, F.col("y0") - F.lag("y0").over(in_line))
    stepped = items.withColumn("_step", step)
    x0s, x1s = (F.collect_list(F.when(is_line, F.col(c))).over(column) for c in ("x0", "x1"))
    edges = stepped.withColumns({"_x0s": x0s, "_x1s": x1s, "_pitch": F.median(F.when(F.col("_step") > 0, F.col("_step"))).over(column)})
    first = F.coalesce(F.when(F.col("col") == 2, F.col("gutter")).otherwise(F.col("left")), F.lit(0.0))
    last = F.coalesce(F.when(F.col("col") == 1, F.col("gutter")).otherwise(F.col("right")), F.lit(1.0))
    known = F.size("_x0s") > 0
    wide = edges.withColumns({"col_left": F.when(known, stats.nearest_rank(F.col("_x0s"), 0.15)).otherwise(first), "col_right": F.when(known, stats.nearest_rank(F.col("_x1s"), 0.85)).otherwise(last)})
    sized = wide if body is None else wide.join(body, "doc_id", "left")
    return sized.withColumns({"col_width": F.greatest(F.lit(1.0), F.col("col_right") - F.col("col_left")), "pitch": F.coalesce("_pitch", 1.3 * F.col("body"))}).drop("_x0s", "_x1s", "_pitch", "_step", "left", "right", "gutter", "band", "no")


def heading_levels(items: DataFrame) -> DataFrame:
    """items of column_stats() with level: 1 to 3 for headings, null for the rest."""
    items = items.withColumn("_text", trimmed(line_text(F.col("spans"))))
    text = F.col("_text")
    in_col = Window.partitionBy(*PAGE, "col", "kind").orderBy("item_no")
    infinite = F.lit(float("inf"))
    before = F.coalesce(F.col("y0") - F.lag("y0").over(in_col), infinite)
    after = F.coalesce(F.lead("y0").over(in_col) - F.col("y0"), infinite)
    open_end = ~text.rlike(r"[.,;]$")
    bold = F.forall("spans", lambda s: F.coalesce(s["b"], F.lit(False)) | (trimmed(s["text"]) == ""))
    plain = (
        F.when((text == "") | (F.length(text) > 150) | ~text.rlike(r"\p{L}"), None)
        .when(F.col("size") >= 1.6 * F.col("body"), 1)
        .when(F.col("size") >= 1.22 * F.col("body"), 2)
        .when(bold & (F.length(text) < 100) & open_end, 3)
    )
    centred = (
        (F.col("size") >= 0.95 * F.col("body"))
        & F.length(text).between(3, 120)
        & open_end
        & text.rlike(r"\p{L}{2}")
        & (F.col("x1") - F.col("x0") <= 0.8 * F.col("col_width"))
        & (F.abs((F.col("x0") + F.col("x1")) / 2 - (F.col("col_left") + F.col("col_right")) / 2) <= 0.06 * F.col("col_width"))
        & (before >= 1.35 * F.col("pitch"))
        & (after >= 1.3 * F.col("pitch"))
    )
    return items.withColumn("level", F.when(F.col("kind") == "line", F.coalesce(plain, F.when(centred, 3))).cast("int")).drop("_text")


def inside(x: Column, y: Column, box: Column) -> Column:
    """Whether a point lies in a box, its edges included."""
    return x.between(box["x0"], box["x1"]) & y.between(box["y0"], box["y1"])


def overlap_share(a: Column, b: Column) -> Column:
    """The intersection of two boxes over the smaller one's area; 0 if that has none."""
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    area = lambda x: (x["x1"] - x["x0"]) * (x["y1"] - x["y0"])
    least = F.least(area(a), area(b))
    return F.when((w > 0) & (h > 0) & (least > 0), w * h / least).otherwise(0.0)


def outside_figures(lines: DataFrame, boxes: DataFrame, sure: float = 75.0) -> DataFrame:
    """lines without the doubtful ones whose centre lies in a figure's box."""
    box = boxes.select("doc_id", "page", F.struct("x0", "y0", "x1", "y1").alias("box"))
    doubtful = F.coalesce(lines["conf"], F.lit(0.0)) < sure
    centre = inside((lines["x0"] + lines["x1"]) / 2, (lines["y0"] + lines["y1"]) / 2, box["box"])
    return lines.join(box, (lines["doc_id"] == box["doc_id"]) & (lines["page"] == box["page"]) & doubtful & centre, "left_anti")


def boxes_without_text(boxes: DataFrame, lines: DataFrame, most: int = 6) -> DataFrame:
    """boxes that hold fewer than `most` line centres."""
    text = lines.select("doc_id", "page", ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"))
    box = boxes.alias("b")
    held = box.join(text.alias("t"), (F.col("b.doc_id") == F.col("t.doc_id")) & (F.col("b.page") == F.col("t.page")) & F.col("cx").between(F.col("b.x0"), F.col("b.x1")) & F.col("cy").between(F.col("b.y0"), F.col("b.y1")))
    full = held.groupBy("b.doc_id", "b.page", "b.fig_no").agg(F.count("*").alias("n")).where(F.col("n") >= most)
    return boxes.join(full.select("doc_id", "page", "fig_no"), ["doc_id", "page", "fig_no"], "left_anti")


def nearest_caption(figures: DataFrame, lines: DataFrame, body: DataFrame, reach: float = CAPTION_REACH) -> DataFrame:
    """doc_id, page, fig_no, line_no, text: each figure's caption-like line, as captions() finds it."""
    found = captions(figures.withColumn("item_no", F.col("fig_no")), lines, body, reach).where(F.size("caption_lines") > 0)
    return found.select(*PAGE, F.col("item_no").alias("fig_no"), F.get("caption_lines", F.lit(0)).alias("line_no"), F.get("caption_texts", F.lit(0)).alias("text"))


def after_caption() -> Column:
    """Whether a line or one above it on its page is like a caption: only these can belong to one."""
    like = trimmed(line_text(F.col("spans"))).rlike(CAPTION)
    return F.coalesce(F.bool_or(like).over(Window.partitionBy(*PAGE).orderBy("y0")), F.lit(False))


def captions(figures: DataFrame, lines: DataFrame, body: DataFrame, reach: float = CAPTION_REACH) -> DataFrame:
    """doc_id, page, item_no, caption_lines, caption_texts of figures (doc_id, page, item_no, y0, y1): the lines that each figure claims; empty for none.

    Figures choose in the order of item_no: each takes the caption-like line, not claimed before, that is nearest to its lower edge, within reach body sizes below
    or above it; and with it up to CAPTION_LINES - 1 lines tight below. Which lines hang together is known before, line by line; the choice is a greedy pass
    over one page's figures and its few caption-like lines.
    """
    caption_like = trimmed(line_text(F.col("spans"))).rlike(CAPTION)
    wanted = figures.select(*PAGE).distinct()
    if "after_caption" in lines.columns:
        lines = lines.where("after_caption")  # said before lines are dealt
    told = lines.join(wanted, PAGE, "left_semi").select(*PAGE, "y0", "line_no", "y1", "x0", line_text(F.col("spans")).alias("text"), caption_like.alias("like"))
    row = F.struct("y0", "line_no", "y1", "x0", "text", "like")
    page_lines = told.groupBy(*PAGE).agg(F.sort_array(F.collect_list(row)).alias("_lines"), F.bool_or("like").alias("_any")).where("_any").join(body, "doc_id")

    def hangs(first: Column) -> Column:
        """The line and those tight below it: each next line in order, up to the first that stands apart."""
        return bound(F.slice(F.filter("_lines", lambda x: x["y0"] > first["y0"]), F.lit(1), F.lit(CAPTION_LINES - 1)), lambda below: held(first, below))

    def held(first: Column, below: Column) -> Column:
        tight = lambda x, k: (x["y0"] - F.when(k == 0, first["y1"]).otherwise(F.get(below, k - 1)["y1"]) < CAPTION_GAP * F.col("body")) & (F.abs(x["x0"] - first["x0"]) < CAPTION_SHIFT * F.col("body"))
        good = F.transform(below, tight)
        upto = F.coalesce(F.nullif(F.array_position(good, F.lit(False)), F.lit(0)) - 1, F.size(below))
        return F.concat(F.array(first), F.slice(below, F.lit(1), upto.cast("int")))

    heads = F.transform(F.filter("_lines", lambda x: x["like"]), lambda x: F.struct(x["y0"].alias("y0"), x["y1"].alias("y1"), x["line_no"].alias("line_no"), hangs(x).alias("held")))
    on_page = figures.groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.struct("item_no", "y0", "y1"))).alias("_figures"))
    met = on_page.join(page_lines.withColumn("_heads", heads).select(*PAGE, "_heads", "_lines", "body"), PAGE)
    first = F.struct(F.array().cast("array<int>").alias("used"), F.array().cast("array<struct<item_no:int,lines:array<int>,texts:array<string>>>").alias("claims"))

    def choose(state: Column, figure: Column) -> Column:
        within = lambda x: (F.abs(x["y0"] - figure["y1"]) < reach * F.col("body")) | (F.abs(figure["y0"] - x["y1"]) < reach * F.col("body"))
        free = F.filter("_heads", lambda x: within(x) & ~F.array_contains(state["used"], x["line_no"]))
        best = F.array_min(F.transform(free, lambda x: F.struct(F.abs(x["y0"] - figure["y1"]).alias("far"), x["line_no"].alias("line_no"), x["held"].alias("held"))))

        def take(held: Column) -> Column:
            claimed = F.transform(held, lambda x: x["line_no"].cast("int"))
            claim = F.struct(figure["item_no"].cast("int").alias("item_no"), claimed.alias("lines"), F.transform(held, lambda x: x["text"]).alias("texts"))
            return F.struct(F.concat(state["used"], claimed).alias("used"), F.concat(state["claims"], F.array(claim)).alias("claims"))

        return bound(F.coalesce(best["held"], F.slice("_lines", 1, 0)), take)

    claims = met.select(*PAGE, F.inline(F.aggregate("_figures", first, choose, lambda s: s["claims"])))
    return claims.select(*PAGE, "item_no", F.col("lines").alias("caption_lines"), F.col("texts").alias("caption_texts"))
