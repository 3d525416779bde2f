"""Whole documents structured: their lines set on pages with headings, quotations, figures with captions, notes and their marks, and the same rules as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.inline import inline
from quire.functions.text import plain_text
from quire.operators import blocks, editing, process
from quire.plans import adapter
from quire.plans.adapter import LINES_SQL
from quire.plans.catalog import oracle_sql, query, table
from quire.plans.families import RUNNING_SQL, headed_blocks
from quire.schemas import BLOCKS, IMAGES, NOTES, PAGES, struct

#: Lines of a page by their number: headings, figures' captions, quotations, and the notes' marks and texts.
_TITLES, _HEADING, _CAPTIONS, _QUOTED, _MARKED, _RAISED, _NOTES = (0, 1), 12, (18, 21), (28, 31), 5, 9, 37
#: Stands in the SQL for a raised 2.
_SIGN = "⁂"


def page_lines(docs: DataFrame) -> DataFrame:
    """The texts' lines as lines of pages (quire.schemas.LINES)."""
    rows = adapter.text_lines(docs)
    no, text = F.col("line_no"), F.col("text")
    told = (
        F.when(no == _MARKED, F.concat(text, F.lit(".1 and so")))
        .when(no == _CAPTIONS[0], F.concat(F.lit("Table 4: "), text))
        .when(no == _CAPTIONS[1], F.concat(F.lit("Figure 3. "), text))
        .when(no == _NOTES, F.concat(F.lit("1. "), text))
        .when(no == 39, F.concat(F.lit("2 "), text))
        .otherwise(text)
    )
    span = lambda t, sup=False: F.struct(t.alias("text"), F.lit(sup).alias("sup"), F.lit(False).alias("i"), F.lit(False).alias("b"))
    spans = F.when(no == _RAISED, F.array(span(text), span(F.lit("2"), True), span(F.lit(" on")))).otherwise(F.array(span(told)))
    size = F.when(no >= _NOTES, 8.5).when(no.isin(*_TITLES), 18.0).when(no == _HEADING, 14.0).otherwise(11.0)
    quoted = no.between(*_QUOTED)
    x0 = F.when(quoted, 120.0).when(F.col("idx") % 7 == 2, 90.0).otherwise(72.0)
    x1 = F.when(quoted, 480.0).when(F.col("n") % 3 == 0, 300.0).otherwise(540.0)
    placed = rows.withColumns({"spans": spans, "size": size, "x0": x0, "x1": x1, "y1": F.col("y0") + size})
    return placed.select("doc_id", "page", "line_no", "spans", "x0", "y0", "x1", "y1", "size", "conf", "para")


def page_figures(docs: DataFrame) -> DataFrame:
    """Two figures on each page of odd number; the caption-like line nearest to both is the same one."""
    one = adapter.boxes(docs)
    return one.unionByName(one.withColumns({"fig_no": F.lit(1), "y0": F.lit(250.0), "y1": F.lit(376.0)}))


def told(content: Column) -> Column:
    """Inline content as text, page breaks as |n|, references as ^id^."""
    one = lambda c: F.when(c["t"] == "text", c["text"]).when(c["t"] == "pb", F.concat(F.lit("|"), c["page"].cast("string"), F.lit("|"))).otherwise(F.concat(F.lit("^"), c["note"], F.lit("^")))
    return F.array_join(F.transform(content, one), "")


_NOTE = r"""^\s*[~_=·•''`"]?\s*([0-9]{1,3}|[*†‡§¶])([.)]\s*\S|\s+\S)"""
_CAPTION = r"(?i)^(fig(ure)?|table|chart|map|plate|exhibit|illustration|graph)\.?\s*[0-9IVX]"
_ENDED = r"""[.!?:;"”’)\]…]$"""
_BEFORE = r"""[\p{Ll}.,;:!?’”"'')\]]"""
_LINE_TEXT = f"CASE line_no WHEN {_MARKED} THEN text || '.1 and so' WHEN {_RAISED} THEN text || '{_SIGN} on' WHEN {_CAPTIONS[0]} THEN 'Table 4: ' || text WHEN {_CAPTIONS[1]} THEN 'Figure 3. ' || text WHEN {_NOTES} THEN '1. ' || text WHEN 39 THEN '2 ' || text ELSE text END"
_RANK = "{0}[floor({1} * (len({0}) - 1) + 0.5)::INT + 1]"
_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_JOINED = r"CASE WHEN following IS NULL THEN t WHEN regexp_matches(t, '\p{L}-$') AND regexp_matches(following, '^\p{Ll}') THEN left(t, length(t) - 1) ELSE t || ' ' END"

_PUT = rf"""put AS (SELECT doc_id, page, line_no, idx, conf, y0, {_LINE_TEXT} AS text, CASE WHEN line_no >= {_NOTES} THEN 8.5 WHEN line_no <= {_TITLES[1]} THEN 18.0 WHEN line_no = {_HEADING} THEN 14.0 ELSE 11.0 END::DOUBLE AS size,
  CASE WHEN line_no BETWEEN {_QUOTED[0]} AND {_QUOTED[1]} THEN 120.0 WHEN idx % 7 = 2 THEN 90.0 ELSE 72.0 END::DOUBLE AS x0, CASE WHEN line_no BETWEEN {_QUOTED[0]} AND {_QUOTED[1]} THEN 480.0 WHEN n % 3 = 0 THEN 300.0 ELSE 540.0 END::DOUBLE AS x1 FROM lines)"""


def _lines_and_notes(put: str = _PUT) -> str:
    """CTEs own (lines that aren't running heads), notes (their lines), body; put: the lines as they are set."""
    return rf"""{LINES_SQL}, pages AS (SELECT DISTINCT doc_id, page FROM lines),
{put},
every AS (SELECT *, y0 + size AS y1 FROM put WHERE {_STRIP.format('text')} <> '' AND NOT (conf < 35 AND length({_STRIP.format('text')}) <= 3)),
{RUNNING_SQL},
gone AS (SELECT told.doc_id, page, line_no, number, top, place FROM told JOIN needed USING (doc_id) LEFT JOIN often USING (doc_id, top, norm) WHERE (number IS NOT NULL AND norm = '') OR apart OR coalesce(times, 0) >= needed),
own AS (SELECT * FROM every e WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = e.doc_id AND g.page = e.page AND g.line_no = e.line_no)),
body AS (SELECT doc_id, median(size) AS body FROM (SELECT doc_id, size, unnest(range(least(80, ceil(length(text) / 10.0))::INT)) FROM own) GROUP BY doc_id),
small AS (SELECT own.*, body, count(*) OVER p AS k, bool_and(size <= 0.88 * body) OVER (PARTITION BY doc_id, page ORDER BY y0 DESC, line_no DESC) AS is_small FROM own JOIN body USING (doc_id) WINDOW p AS (PARTITION BY doc_id, page)),
numbered AS (SELECT *, sum(CASE WHEN regexp_matches(text, '{_NOTE}') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY y0, line_no) AS note_no FROM small WHERE k >= 3 AND is_small),
foot AS (SELECT *, count(*) OVER p AS b, min(y0) OVER p AS first_y FROM numbered WHERE note_no > 0 WINDOW p AS (PARTITION BY doc_id, page)),
notes AS (SELECT *, CASE WHEN regexp_matches(text, '{_NOTE}') THEN substr(text, length(regexp_extract(text, '{_NOTE}'))) ELSE text END AS rest, regexp_extract(text, '{_NOTE}', 1) AS mark FROM foot WHERE b <= 0.5 * k AND first_y >= 0.45 * 792)"""


def _pieces(figures: str = "(0, 240.0::DOUBLE, 380.0::DOUBLE), (1, 250.0, 376.0)") -> str:
    """CTEs places (each note's piece, run and place of its reference) and linked (pieces); figures: those of pages of odd number."""
    return rf"""lined AS (SELECT own.*, body FROM own JOIN body USING (doc_id) WHERE NOT EXISTS (SELECT 1 FROM notes n WHERE n.doc_id = own.doc_id AND n.page = own.page AND n.line_no = own.line_no)),
steps AS (SELECT *, y0 - lag(y0) OVER w AS step, lead(y0) OVER w - y0 AS after FROM lined WINDOW w AS (PARTITION BY doc_id, page ORDER BY y0, line_no)),
sorted AS (SELECT doc_id, page, list_sort(list(x0)) AS l, list_sort(list(x1)) AS r, median(step) FILTER (WHERE step > 0) AS pitch FROM steps GROUP BY doc_id, page),
edges AS (SELECT doc_id, page, {_RANK.format('l', 0.15)} AS col_left, {_RANK.format('r', 0.85)} AS col_right, greatest(1.0, {_RANK.format('r', 0.85)} - {_RANK.format('l', 0.15)}) AS width, pitch FROM sorted),
levels AS (SELECT doc_id, page, line_no, x0, x1, y0, y1, size, body, text, col_left, col_right, width, coalesce(pitch, 1.3 * body) AS pitch, {_STRIP.format('text')} AS t, coalesce(step, 'inf'::DOUBLE) AS before, coalesce(after, 'inf'::DOUBLE) AS after FROM steps JOIN edges USING (doc_id, page)),
headed AS (SELECT *, CASE WHEN length(t) <= 150 AND regexp_matches(t, '\p{{L}}') AND size >= 1.6 * body THEN 1 WHEN length(t) <= 150 AND regexp_matches(t, '\p{{L}}') AND size >= 1.22 * body THEN 2
  WHEN size >= 0.95 * body AND length(t) BETWEEN 3 AND 120 AND NOT regexp_matches(t, '[.,;]$') AND regexp_matches(t, '\p{{L}}{{2}}') AND x1 - x0 <= 0.8 * width AND abs((x0 + x1) / 2 - (col_left + col_right) / 2) <= 0.06 * width AND before >= 1.35 * pitch AND after >= 1.3 * pitch THEN 3 END AS level FROM levels),
figures AS (SELECT doc_id, page, fig_no, y0, y1, body FROM (SELECT doc_id, page FROM pages WHERE page % 2 = 1) JOIN body USING (doc_id), (VALUES {figures}) AS f(fig_no, y0, y1)),
likely AS (SELECT * FROM headed WHERE regexp_matches(t, '{_CAPTION}')),
below AS (SELECT h.doc_id, h.page, h.line_no AS head, l.line_no, l.text, l.y0, l.x0, l.y1, h.y1 AS head_y1, h.x0 AS head_x0, h.body, row_number() OVER (PARTITION BY h.doc_id, h.page, h.line_no ORDER BY l.y0, l.line_no) AS r FROM likely h JOIN headed l ON l.doc_id = h.doc_id AND l.page = h.page AND l.y0 > h.y0),
tight AS (SELECT *, bool_and(fits) OVER (PARTITION BY doc_id, page, head ORDER BY r) AS held FROM (SELECT *, y0 - coalesce(lag(y1) OVER (PARTITION BY doc_id, page, head ORDER BY r), head_y1) < 0.6 * body AND abs(x0 - head_x0) < 3 * body AS fits FROM below WHERE r <= 3)),
chains AS (SELECT doc_id, page, line_no AS head, line_no, text, 0 AS r FROM likely UNION ALL SELECT doc_id, page, head, line_no, text, r FROM tight WHERE held),
near AS (SELECT f.doc_id, f.page, fig_no, line_no AS head, abs(l.y0 - f.y1) AS far FROM figures f JOIN likely l ON l.doc_id = f.doc_id AND l.page = f.page AND (abs(l.y0 - f.y1) < 4 * f.body OR abs(f.y0 - l.y1) < 4 * f.body)),
first_claim AS (SELECT doc_id, page, 0 AS fig_no, arg_min(head, (far, head)) AS head FROM near WHERE fig_no = 0 GROUP BY doc_id, page),
second_claim AS (SELECT doc_id, page, 1 AS fig_no, arg_min(head, (far, head)) AS head FROM near n WHERE fig_no = 1 AND NOT EXISTS (SELECT 1 FROM first_claim c JOIN chains x ON x.doc_id = c.doc_id AND x.page = c.page AND x.head = c.head WHERE c.doc_id = n.doc_id AND c.page = n.page AND x.line_no = n.head) GROUP BY doc_id, page),
claimed AS (SELECT c.doc_id, c.page, c.fig_no, x.line_no, x.text, x.r FROM (FROM first_claim UNION ALL FROM second_claim) c JOIN chains x ON x.doc_id = c.doc_id AND x.page = c.page AND x.head = c.head),
items AS (SELECT doc_id, page, 'line' AS kind, line_no AS no, x0, x1, y0, y1, size, body, t, col_left, col_right, width, pitch, level, NULL AS caption FROM headed h WHERE NOT EXISTS (SELECT 1 FROM claimed c WHERE c.doc_id = h.doc_id AND c.page = h.page AND c.line_no = h.line_no)
  UNION ALL SELECT f.doc_id, f.page, 'figure', f.fig_no, NULL, NULL, f.y0, f.y1, NULL, body, NULL, NULL, NULL, NULL, NULL, NULL, (SELECT {_STRIP.format("string_agg(replace(text, '" + _SIGN + "', '2'), ' ' ORDER BY r)")} FROM claimed c WHERE c.doc_id = f.doc_id AND c.page = f.page AND c.fig_no = f.fig_no) FROM figures f),
looked AS (SELECT *, row_number() OVER w AS item_no, lag(kind) OVER w AS p_kind, lag(level) OVER w AS p_level, lag(y0) OVER w AS p_y0, lag(y1) OVER w AS p_y1, lag(x0) OVER w AS p_x0, lag(x1) OVER w AS p_x1, regexp_matches(lag(t) OVER w, '{_ENDED}') AS ended FROM items WINDOW w AS (PARTITION BY doc_id, page ORDER BY y0, kind DESC, no)),
opened AS (SELECT *, CASE WHEN kind = 'figure' OR coalesce(p_kind, 'figure') = 'figure' THEN 1 WHEN (level IS NULL) <> (p_level IS NULL) THEN 1 WHEN level IS NOT NULL THEN CASE WHEN level = p_level AND y0 - p_y1 < 0.9 * size THEN 0 ELSE 1 END
  WHEN y0 - p_y0 > 1.55 * pitch OR y0 < p_y0 OR (x0 - col_left > 0.8 * body AND NOT p_x0 - col_left > 0.8 * body) OR (col_right - p_x1 > 0.12 * width AND ended) THEN 1 ELSE 0 END AS opens FROM looked),
grouped AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id, page ORDER BY item_no) - 1 AS piece FROM opened),
joining AS (SELECT *, lead(t) OVER (PARTITION BY doc_id, page, piece ORDER BY item_no) AS following FROM grouped),
pieces AS (SELECT doc_id, page, piece, CASE WHEN max(kind) = 'figure' THEN 'figure' WHEN max(level) IS NOT NULL THEN 'heading' ELSE 'paragraph' END AS kind, max(level) AS level, max(caption) AS caption, string_agg({_JOINED}, '' ORDER BY item_no) AS text,
  CASE WHEN max(kind) = 'line' AND max(level) IS NULL AND count(*) > 1 AND bool_and(x0 - col_left > 1.5 * body AND col_right - x1 > 1.5 * body) FILTER (WHERE opens = 0) THEN 'quote' END AS style FROM joining GROUP BY doc_id, page, piece),
runs AS (SELECT doc_id, page, piece, kind, unnest(string_split(text, '{_SIGN}')) AS run, unnest(range(len(string_split(text, '{_SIGN}')))) AS nth, len(string_split(text, '{_SIGN}')) AS parts FROM pieces WHERE kind <> 'figure'),
asked AS (SELECT doc_id, page, note_no, arg_min(mark, line_no) AS mark FROM notes GROUP BY doc_id, page, note_no),
found AS (SELECT a.doc_id, a.page, a.note_no, a.mark, piece, 2 * nth AS run_no, length(regexp_extract(run, '(?s)^(.*?' || $${_BEFORE.replace("''", "'")}$$ || ')' || CASE WHEN regexp_matches(mark, '[0-9]') THEN mark ELSE '[' || mark || ']' END || '(?:[\s,.;:)]|$)', 1)) AS glued, length(regexp_extract(run, '(?s)^(.*?[.,;:])[!|](?:\s|$)', 1)) AS misread
  FROM asked a JOIN runs r ON r.doc_id = a.doc_id AND r.page = a.page AND r.kind = 'paragraph'
  UNION ALL SELECT a.doc_id, a.page, a.note_no, a.mark, piece, 2 * nth + 1, -1, 0 FROM asked a JOIN runs r ON r.doc_id = a.doc_id AND r.page = a.page AND a.mark = '2' AND nth + 1 < parts),
places AS (SELECT doc_id, page, note_no, mark, arg_min({{'piece': piece, 'run_no': run_no, 'pos': CASE WHEN glued <> 0 THEN glued ELSE misread END}}, (piece, run_no)) AS place FROM found WHERE glued <> 0 OR (mark = '1' AND misread > 0) GROUP BY doc_id, page, note_no, mark),
split AS (SELECT r.doc_id, r.page, r.piece, 2 * nth AS run_no, run AS text FROM runs r UNION ALL SELECT doc_id, page, piece, 2 * nth + 1, '2' FROM runs WHERE nth + 1 < parts),
set_in AS (SELECT s.doc_id, s.page, s.piece, s.run_no, coalesce(arg_max(CASE WHEN p.place.pos = -1 THEN '^n' || (s.page + 1) || '-' || p.note_no || '^' ELSE left(s.text, p.place.pos) || '^n' || (s.page + 1) || '-' || p.note_no || '^' || substr(s.text, p.place.pos + 2) END, p.note_no), s.text) AS text
  FROM split s LEFT JOIN places p ON p.doc_id = s.doc_id AND p.page = s.page AND p.place.piece = s.piece AND p.place.run_no = s.run_no GROUP BY s.doc_id, s.page, s.piece, s.run_no, s.text),
linked AS (SELECT p.doc_id, p.page, p.piece, p.kind, p.level, p.style, p.caption, string_agg(s.text, '' ORDER BY s.run_no) AS text FROM pieces p LEFT JOIN set_in s USING (doc_id, page, piece) GROUP BY ALL)"""


_BARE = r"regexp_replace({0}, '\^n[0-9]+-[0-9]+\^', '', 'g')"
_MERGED = rf"""ahead AS (SELECT *, lag(kind) OVER w AS p_kind, lag(style) OVER w AS p_style, {_STRIP.format('lag(text) OVER w')} AS p_text FROM linked WINDOW w AS (PARTITION BY doc_id ORDER BY page, piece)),
on_pages AS (SELECT *, CASE WHEN piece = 0 AND kind = 'paragraph' AND p_kind = 'paragraph' AND style IS NOT DISTINCT FROM p_style AND {_BARE.format('p_text')} <> '' AND {_BARE.format('text')} <> '' AND (NOT regexp_matches({_BARE.format('p_text')}, '{_ENDED}') OR regexp_matches({_BARE.format('p_text')}, '\p{{L}}-$') OR regexp_matches({_BARE.format('text')}, '^\s*\p{{Ll}}')) THEN 0 ELSE 1 END AS opens FROM ahead),
counted AS (SELECT *, (sum(opens) OVER (PARTITION BY doc_id ORDER BY page, piece) - 1)::INT AS block_no FROM on_pages),
paired AS (SELECT *, lead(text) OVER w AS following, lead(page) OVER w AS next_page, lag(text) OVER w AS preceding FROM counted WINDOW w AS (PARTITION BY doc_id, block_no ORDER BY page, piece)),
halves AS (SELECT *, CASE WHEN preceding IS NOT NULL AND regexp_matches(preceding, '\p{{L}}-$') AND regexp_matches(text, '^\p{{Ll}}') THEN regexp_replace(text, '^\S+', '') ELSE text END AS head,
  CASE WHEN following IS NULL THEN '' WHEN regexp_matches(text, '\p{{L}}-$') AND regexp_matches(following, '^\p{{Ll}}') THEN regexp_extract(following, '^\S+') || '|' || next_page || '|' WHEN regexp_matches(text, '\^$') THEN '|' || next_page || '|' ELSE ' |' || next_page || '|' END AS tail,
  following IS NOT NULL AND regexp_matches(text, '\p{{L}}-$') AND regexp_matches(following, '^\p{{Ll}}') AS broken FROM paired)"""


_BLOCKS = """SELECT doc_id, block_no, arg_min(kind, page) AS kind, arg_min(level, page)::INT AS level, arg_min(style, page) AS style, min(page)::INT AS page, CASE WHEN arg_min(kind, page) = 'figure' THEN '[' || coalesce(arg_min(caption, page), '') || ']' ELSE string_agg(CASE WHEN broken THEN left(head, length(head) - 1) ELSE head END || tail, '' ORDER BY page, piece) END AS text FROM halves GROUP BY doc_id, block_no"""


@query(rf"""WITH {_lines_and_notes()}, {_pieces()}, {_MERGED}
{_BLOCKS}""")
def structured_documents(spark, sf):
    """Blocks of all documents: headings, paragraphs, broken words, quotations, figures that compete for captions, note references, text over page ends; without noise and running heads."""
    docs = table(spark, sf, "documents")
    made = blocks.structure(page_lines(docs), adapter.layouts(docs), page_figures(docs))[1]
    text = F.when(F.col("kind") == "figure", F.concat(F.lit("["), F.coalesce("caption", F.lit("")), F.lit("]"))).otherwise(told(F.col("content")))
    return made.select("doc_id", "block_no", "kind", "level", "style", "page", text.alias("text"))


@query(rf"""WITH {_lines_and_notes()}, noted AS (SELECT doc_id, page, note_no, line_no, mark, {_STRIP.format('rest')} AS t FROM notes), followed AS (SELECT *, lead(t) OVER (PARTITION BY doc_id, page, note_no ORDER BY line_no) AS following FROM noted)
SELECT doc_id, 'n' || (page + 1) || '-' || note_no AS id, arg_min(mark, line_no) AS marker, string_agg({_JOINED}, '' ORDER BY line_no) AS text, page FROM followed GROUP BY doc_id, page, note_no""")
def structured_notes(spark, sf):
    """Notes at the foot of all documents' pages."""
    docs = table(spark, sf, "documents")
    return blocks.structured_notes(page_lines(docs), adapter.layouts(docs)).select("doc_id", "id", "marker", told(F.col("content")).alias("text"), "page")


@query(rf"""WITH {_lines_and_notes()}, shown AS (SELECT doc_id, page, arg_min(number, (CASE WHEN top THEN 0 ELSE 1 END, place)) AS shown FROM gone WHERE number IS NOT NULL GROUP BY doc_id, page),
offs AS (SELECT doc_id, page, shown::INT - page AS off FROM shown WHERE regexp_full_match(shown, '[0-9]+')),
cnt AS (SELECT doc_id, off, count(*) AS times, min(page) AS first FROM offs GROUP BY doc_id, off),
best AS (SELECT doc_id, off, times, total, row_number() OVER (PARTITION BY doc_id ORDER BY times DESC, first) AS r FROM (SELECT *, sum(times) OVER (PARTITION BY doc_id) AS total FROM cnt)),
how_many AS (SELECT doc_id, count(*) AS n_pages FROM pages GROUP BY doc_id)
SELECT p.doc_id, p.page, CASE WHEN shown IS NOT NULL AND NOT regexp_full_match(shown, '[0-9]+') THEN shown WHEN (times >= 2 OR (total = 1 AND n_pages <= 2)) AND times >= 0.4 * total AND p.page + off >= 1 THEN (p.page + off)::VARCHAR ELSE coalesce(shown, '') END AS label
FROM pages p JOIN how_many USING (doc_id) LEFT JOIN shown s USING (doc_id, page) LEFT JOIN best ON best.doc_id = p.doc_id AND best.r = 1""")
def structured_pages(spark, sf):
    """Labels of all documents' pages, from the numbers that running lines show."""
    docs = table(spark, sf, "documents")
    return blocks.structured_pages(page_lines(docs), adapter.layouts(docs)).select("doc_id", "page", "label")


@query(rf"""WITH {_lines_and_notes("put AS (SELECT doc_id, page, line_no, idx, conf, y0, text, size, x0, x1 FROM lines)")}, {_pieces("(0, 240.0::DOUBLE, 380.0::DOUBLE)")}, {_MERGED}, made AS ({_BLOCKS})
SELECT doc_id, block_no, kind, level, style, page, CASE WHEN kind = 'figure' THEN '' ELSE regexp_replace(text, '\^n[0-9]+-[0-9]+\^|\|[0-9]+\|', '', 'g') END AS text FROM made""")
def structure_blocks(spark, sf):
    """Blocks of every document, through all structuring steps, from lines as they come."""
    docs = table(spark, sf, "documents")
    _, made, _ = blocks.structure(adapter.lines(docs), adapter.layouts(docs), adapter.boxes(docs))
    return made.select("doc_id", "block_no", "kind", "level", "style", "page", plain_text(F.col("content")).alias("text"))


@query(f"WITH {LINES_SQL} SELECT doc_id, page, CASE WHEN sum(length(trim(text))) >= 40 THEN 'text' ELSE 'ocr' END AS source FROM lines GROUP BY doc_id, page")
def routed_pages(spark, sf):
    """Pages whose text layer is used, and those that are left to recognition."""
    docs = table(spark, sf, "documents")
    return process.routed(adapter.layouts(docs), adapter.text_lines(docs).select("doc_id", "page", F.col("text").alias("str"))).select("doc_id", "page", "source")


@query(f"""WITH heads AS ({oracle_sql()["first_headings"]})
SELECT d.doc_id::VARCHAR AS doc_id, coalesce(CASE WHEN d.doc_id % 3 = 0 THEN 'Own title ' || d.doc_id END, title) AS title, CASE WHEN d.doc_id % 2 = 0 THEN 'An Author' END AS author FROM documents d LEFT JOIN heads ON heads.doc_id::VARCHAR = d.doc_id::VARCHAR""")
def reading_titles(spark, sf):
    """A file's own title if it is sound, else the first heading; an author of more than one letter."""
    key = F.col("doc_id")
    own = F.when(key % 3 == 0, F.concat(F.lit("Microsoft Word - Own title "), key.cast("string"), F.lit(".doc"))).when(key % 3 == 1, F.lit("untitled"))
    known = table(spark, sf, "documents").select(key.cast("string").alias("doc_id"), own.alias("title"), F.when(key % 2 == 0, F.lit(" An Author ")).otherwise(F.lit("x")).alias("author"))
    none = lambda ddl: spark.createDataFrame([], ddl)
    return process.titles(process.Structured(none(PAGES), headed_blocks(spark, sf), none(NOTES), none(IMAGES), none("doc_id string, error string")), known).select("doc_id", "title", "author")


@query("""SELECT conv_id, turn, trim(regexp_replace(text || CASE WHEN turn % 3 = 0 THEN '⟦note ' || (turn + 1) || '⟧' ELSE '' END || CASE WHEN turn % 2 = 0 THEN ' ⟦p. ' || (turn + 40) || '⟧ ' ELSE ' ⟦p. ' || (turn + 1) || '⟧ ' END, ' {2,}', ' ', 'g'), ' ') AS text FROM conversations""")
def editable_texts(spark, sf):
    """Turns as text to edit: each with a reference, known or not, and the mark of a page with or without a printed label."""
    turn = F.col("turn")
    note = F.concat(F.lit("n"), turn.cast("string"))
    content = F.array(inline("text", F.col("text")), inline("noteref", note=note), inline("pb", page=turn))
    markers = F.when(turn % 3 == 0, F.create_map(note, (turn + 1).cast("string"))).otherwise(F.create_map(F.lit("other"), F.lit("1")))
    labels = F.create_map(turn.cast("int"), F.when(turn % 2 == 0, (turn + 40).cast("string")).otherwise(F.lit("")))
    return table(spark, sf, "conversations").select("conv_id", "turn", editing.editable(content, markers, labels).alias("text"))


_EDIT = " ⟦note 0⟧ mid   dle ⟦p. 41⟧⟦ note x ⟧ end\n⟦p. 40⟧ "


@query(r"""WITH n AS (SELECT conv_id, min(turn) FILTER (turn % 4 = 0) AS note, min(turn) FILTER (turn % 6 = 3 OR turn % 3 <> 0 AND turn = 40) AS p41, min(turn) FILTER (turn % 6 = 0 OR turn % 3 <> 0 AND turn = 39) AS p40 FROM conversations GROUP BY 1),
o AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN turn ELSE note END AS note, p41, CASE WHEN turn % 6 = 0 THEN turn ELSE p40 END AS p40, regexp_replace(text, '\s+', ' ', 'g') AS t, text FROM conversations JOIN n USING (conv_id))
SELECT conv_id, turn, md5(CASE WHEN turn % 2 = 1 THEN text || '^n' || turn || '^|' || turn || '|' ELSE ltrim(t || ' ') || coalesce('^n' || note || '^', '') || ' mid dle ' || coalesce('|' || p41 || '|', '') || ' end ' || coalesce('|' || p40 || '|', '') END) AS digest FROM o""")
def edited_turns(spark, sf):
    """Turns as blocks with a reference and a page break, edited: some as they were shown, some with tokens for notes and pages of their own, of the document, of none."""
    turns = table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("doc_id"), F.col("turn").cast("int").alias("block_no"), "text")
    no = F.col("block_no")
    note, marker = F.concat(F.lit("n"), no), (no % 4).cast("string")
    label = F.when(no % 3 == 0, (no % 2 + 40).cast("string"))
    content = F.array(inline("text", F.col("text")), inline("noteref", note=note), inline("pb", page=no))
    made = spark.createDataFrame([], struct(BLOCKS)).unionByName(turns.select("doc_id", "block_no", F.lit("paragraph").alias("kind"), content.alias("content")), allowMissingColumns=True)
    notes = spark.createDataFrame([], struct(NOTES)).unionByName(turns.where(no % 2 == 0).select("doc_id", no.alias("note_no"), note.alias("id"), marker.alias("marker"), no.alias("page")), allowMissingColumns=True)
    pages = spark.createDataFrame([], struct(PAGES)).unionByName(turns.select("doc_id", no.alias("page"), label.alias("label")), allowMissingColumns=True)
    as_shown = editing.editable(content, F.create_map(F.lit(""), F.lit("")), F.create_map(no, label))
    edits = turns.where(no % 4 != 3).select("doc_id", "block_no", F.when(no % 2 == 1, as_shown).otherwise(F.concat("text", F.lit(_EDIT))).alias("text"))
    done = editing.apply_edits(made, edits, notes, pages)
    return done.select(F.col("doc_id").cast("long").alias("conv_id"), F.col("block_no").cast("long").alias("turn"), F.md5(told(F.col("content"))).alias("digest"))
