"""The registry of queries and of their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import hashing, stats, text
from quire.operators import blocks, bundle, layout, render, toc
from quire.operators.bundle import BundleSettings
from quire.plans import adapter
from quire.plans.adapter import LINES_SQL
from quire.schemas import BLOCKS, NOTES, struct
from quire.sources import html, pdf_items

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

#: How a finished sentence ends, for an engine without look-around.
_TERMINAL_SQL = r"""[.!?:;"”’)\]…]$"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def register(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_runs(spark, sf_dir)


# Lines and paragraphs


@query(f"WITH {LINES_SQL} SELECT doc_id, page, line_no, text, n AS n_chars, size, x0, y0, x1, y1 FROM lines")
def doc_lines(spark, sf):
    return adapter.text_lines(table(spark, sf, "documents")).select("doc_id", "page", "line_no", "text", F.col("n").alias("n_chars"), "size", "x0", "y0", "x1", "y1")


@query(f"WITH {LINES_SQL} SELECT doc_id, page, line_no, conf FROM lines WHERE trim(text) <> '' AND NOT (conf < 35 AND length(trim(text)) <= 3)")
def noise_filter(spark, sf):
    return layout.noise_filter(adapter.lines(table(spark, sf, "documents"))).select("doc_id", "page", "line_no", "conf")


@query(f"""WITH {LINES_SQL},
marked AS (SELECT doc_id, idx, text, lag(text) OVER w AS before FROM lines WHERE trim(text) <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY idx)),
opened AS (SELECT *, CASE WHEN before IS NULL OR (regexp_matches(before, '{_TERMINAL_SQL.replace("'", "''")}') AND NOT regexp_matches(text, '^\\p{{Ll}}')) THEN 1 ELSE 0 END AS opens FROM marked),
runs AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY idx) AS run FROM opened),
made AS (SELECT doc_id, run, count(*) AS k, string_agg(text, ' ' ORDER BY idx) AS text FROM runs GROUP BY doc_id, run)
SELECT doc_id, count(*)::BIGINT AS n_paragraphs, max(k)::BIGINT AS most_lines, sum(length(text))::BIGINT AS n_chars, md5(string_agg(text, chr(10) ORDER BY run)) AS digest FROM made GROUP BY doc_id""")
def paragraph_runs(spark, sf):
    """Lines that go on in the next one put together, per document."""
    rows = adapter.text_lines(table(spark, sf, "documents")).where(F.trim("text") != "")
    order = Window.partitionBy("doc_id").orderBy("idx")
    before = F.lag("text").over(order)
    opens = before.isNull() | (before.rlike(text.TERMINAL) & ~F.col("text").rlike(r"^\p{Ll}"))
    runs = rows.select("doc_id", "idx", "text", opens.cast("int").alias("opens")).withColumn("run", F.sum("opens").over(order))
    made = runs.groupBy("doc_id", "run").agg(F.count("*").alias("k"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), " ").alias("text"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("run", "text"))), lambda x: x["text"]), "\n")
    return made.groupBy("doc_id").agg(F.count("*").alias("n_paragraphs"), F.max("k").alias("most_lines"), F.sum(F.length("text")).cast("long").alias("n_chars"), F.md5(joined).alias("digest"))


@query(r"""WITH halves AS (SELECT item_id, left(text, length(text) // 2) || '-' AS prev, substr(text, length(text) // 2 + 1) AS following FROM benchmark)
SELECT item_id, md5(CASE WHEN regexp_matches(prev, '\p{L}-$') AND regexp_matches(following, '^\p{Ll}') THEN left(prev, length(prev) - 1) || following WHEN regexp_matches(following, '^\s') THEN prev || following ELSE prev || ' ' || following END) AS digest FROM halves""")
def dehyphenate(spark, sf):
    cut = F.floor(F.length("text") / 2).cast("int")
    halves = table(spark, sf, "benchmark").select("item_id", F.concat(F.substring("text", F.lit(1), cut), F.lit("-")).alias("prev"), F.substring("text", cut + 1, F.length("text")).alias("following"))
    return halves.select("item_id", F.md5(text.joined(F.col("prev"), F.col("following"))).alias("digest"))


@query(r"""WITH heads AS (SELECT item_id, lower(text) AS a, lag(lower(text)) OVER (ORDER BY item_id) AS b FROM benchmark),
grams AS (SELECT item_id, a, b, [substr(a, i, 2) for i in range(1, length(a))] AS ga, [substr(b, i, 2) for i in range(1, length(b))] AS gb FROM heads WHERE b IS NOT NULL)
SELECT item_id, CASE WHEN a = b THEN 1.0 WHEN length(a) < 2 OR length(b) < 2 THEN 0.0 ELSE 2.0 * list_sum([least(len(list_filter(ga, lambda h: h = g)), len(list_filter(gb, lambda h: h = g))) for g in list_distinct(ga)]) / (length(a) + length(b) - 2) END::DOUBLE AS similarity FROM grams""")
def dice_similarity(spark, sf):
    items = table(spark, sf, "benchmark").select("item_id", F.lower("text").alias("a"))
    last = items.select((F.col("item_id") + 1).alias("item_id"), F.col("a").alias("b"))
    return items.join(last, "item_id").select("item_id", text.dice(F.col("a"), F.col("b")).cast("double").alias("similarity"))


@query(f"""WITH {LINES_SQL}, told AS (SELECT doc_id, size, least(80, ceil(n / 10.0))::INT AS w FROM lines), every AS (SELECT doc_id, size, unnest(range(w)) FROM told)
SELECT d.doc_id, coalesce(median(size), 0.0)::DOUBLE AS body FROM (SELECT DISTINCT doc_id FROM lines) d LEFT JOIN every USING (doc_id) GROUP BY d.doc_id""")
def body_size(spark, sf):
    return layout.body_size(adapter.lines(table(spark, sf, "documents")))


@query("""WITH v AS (SELECT l_orderkey, list_sort(list(l_extendedprice)) AS v FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, v[floor(0.15 * (len(v) - 1) + 0.5)::INT + 1] AS q15, v[floor(0.85 * (len(v) - 1) + 0.5)::INT + 1] AS q85 FROM v""")
def nearest_rank_quantiles(spark, sf):
    grouped = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_extendedprice").alias("v"))
    return grouped.select("l_orderkey", stats.nearest_rank(F.col("v"), 0.15).alias("q15"), stats.nearest_rank(F.col("v"), 0.85).alias("q85"))


@query(f"WITH {LINES_SQL} SELECT doc_id, page, min(y0) AS top, max(y1) AS bottom, median(size) AS median_size FROM lines GROUP BY doc_id, page")
def page_extents(spark, sf):
    return layout.page_extents(adapter.lines(table(spark, sf, "documents")))


@query(f"""WITH {LINES_SQL}, d AS (SELECT doc_id, idx AS page, CASE WHEN n % 5 = 0 THEN NULL WHEN n % 7 = 0 THEN 'iv' WHEN n % 4 = 0 THEN (idx * 3)::VARCHAR ELSE (idx + 16)::VARCHAR END AS shown FROM lines),
o AS (SELECT doc_id, page, shown::INT - page AS off FROM d WHERE regexp_full_match(shown, '[0-9]+')),
c AS (SELECT doc_id, off, count(*) AS times, min(page) AS first FROM o GROUP BY doc_id, off),
b AS (SELECT doc_id, off, times, total, row_number() OVER (PARTITION BY doc_id ORDER BY times DESC, first) AS r FROM (SELECT *, sum(times) OVER (PARTITION BY doc_id) AS total FROM c)),
n AS (SELECT doc_id, count(*) AS pages FROM d GROUP BY doc_id)
SELECT d.doc_id, d.page, CASE WHEN shown = 'iv' THEN shown WHEN (times >= 2 OR (total = 1 AND pages <= 2)) AND times >= 0.4 * total AND d.page + off >= 1 THEN (d.page + off)::VARCHAR ELSE coalesce(shown, '') END AS label
FROM d JOIN n USING (doc_id) LEFT JOIN b ON b.doc_id = d.doc_id AND b.r = 1""")
def page_labels(spark, sf):
    """Page labels repaired: each line of a text stands for a page, some with misread, roman or missing numbers."""
    n, idx = F.col("n"), F.col("idx")
    shown = F.when(n % 5 == 0, None).when(n % 7 == 0, "iv").when(n % 4 == 0, (idx * 3).cast("string")).otherwise((idx + 16).cast("string"))
    rows = adapter.text_lines(table(spark, sf, "documents")).select("doc_id", idx.alias("page"), shown.alias("number"), F.lit(0).alias("end"), F.lit(1).alias("place"))
    pages = rows.select("doc_id", "page", F.lit(None).cast("string").alias("pdf_label"))
    return layout.page_labels(pages, rows).select("doc_id", "page", "label")


_NUMBER_SQL = "(CASE WHEN regexp_full_match({0}, '[0-9]+') THEN ({0})::INT::VARCHAR WHEN {0} <> '' AND regexp_full_match({0}, '(?i)m{{0,3}}(cm|cd|d?c{{0,3}})(xc|xl|l?x{{0,3}})(ix|iv|v?i{{0,3}})') AND (length(t) <= 4 OR length(regexp_replace(regexp_replace(t, '[^A-Za-z]', '', 'g'), '(?i)[ivxlcdm]', '', 'g')) > 0) THEN lower({0}) END)"


@query(f"""WITH {LINES_SQL}, told AS (SELECT doc_id, idx, CASE WHEN idx % 3 = 0 THEN '— ' || idx || ' —' WHEN idx % 3 = 1 THEN text || ' ' || idx ELSE text END AS raw_text FROM lines),
t AS (SELECT *, regexp_replace(regexp_replace(raw_text, '^[\\s–—-]+', ''), '[\\s–—-]+$', '') AS t FROM told),
found AS (SELECT *, regexp_extract(t, '(?i)^(?:page\\s+)?([0-9]{{1,4}}|[ivxlcdm]{{1,7}})(?:\\s|$)', 1) AS head, regexp_extract(t, '(?i)(?:^|\\s)([0-9]{{1,4}}|[ivxlcdm]{{1,7}})$', 1) AS tail FROM t)
SELECT doc_id, idx, coalesce({_NUMBER_SQL.format('head')}, {_NUMBER_SQL.format('tail')}) AS number FROM found""")
def page_numbers(spark, sf):
    idx, t = F.col("idx"), F.col("text")
    shown = F.when(idx % 3 == 0, F.concat(F.lit("— "), idx, F.lit(" —"))).when(idx % 3 == 1, F.concat(t, F.lit(" "), idx)).otherwise(t)
    return adapter.text_lines(table(spark, sf, "documents")).select("doc_id", "idx", text.page_number(shown).alias("number"))


@query(f"""WITH {LINES_SQL}, told AS (SELECT *, CASE WHEN line_no >= 37 AND line_no % 2 = 1 THEN '1. ' || text ELSE text END AS told FROM lines),
small AS (SELECT *, count(*) OVER p AS k, bool_and(size <= 0.88 * 11) OVER (PARTITION BY doc_id, page ORDER BY y0 DESC, line_no DESC) AS is_small FROM told WINDOW p AS (PARTITION BY doc_id, page)),
tail AS (SELECT *, sum(CASE WHEN regexp_matches(told, '^\\s*[~_=·•''`"]?\\s*([0-9]{{1,3}}|[*†‡§¶])([.)]\\s*\\S|\\s+\\S)') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY y0, line_no) AS note_no FROM small WHERE k >= 3 AND is_small),
block AS (SELECT *, count(*) OVER p AS b, min(y0) OVER p AS top FROM tail WHERE note_no > 0 WINDOW p AS (PARTITION BY doc_id, page))
SELECT doc_id, page, line_no, note_no::BIGINT AS note_no FROM block WHERE b <= 0.5 * k AND top >= 0.45 * 792""")
def footnotes(spark, sf):
    docs = table(spark, sf, "documents")
    rows = adapter.text_lines(docs)
    told = F.when((F.col("line_no") >= 37) & (F.col("line_no") % 2 == 1), F.concat(F.lit("1. "), F.col("text"))).otherwise(F.col("text"))
    lines = rows.withColumn("spans", F.transform("spans", lambda s: s.withField("text", told))).select("doc_id", "page", "line_no", "spans", "x0", "y0", "x1", "y1", "size", "conf", "para")
    body = rows.select("doc_id").distinct().withColumn("body", F.lit(11.0))
    return layout.footnotes(lines, adapter.layouts(docs), body).select("doc_id", "page", "line_no", "note_no")


@query(f"""WITH {LINES_SQL}, near AS (SELECT *, coalesce(y0 - lag(y0) OVER w, 'inf'::DOUBLE) AS before, coalesce(lead(y0) OVER w - y0, 'inf'::DOUBLE) AS after, trim(text) AS t FROM lines WINDOW w AS (PARTITION BY doc_id, page ORDER BY line_no))
SELECT doc_id, page, line_no, CASE WHEN t = '' OR length(t) > 150 OR NOT regexp_matches(t, '\\p{{L}}') THEN NULL WHEN size >= 17.6 THEN 1 WHEN size >= 13.42 THEN 2 END::INT AS level FROM near""")
def heading_levels(spark, sf):
    rows = adapter.lines(table(spark, sf, "documents"))
    fixed = {"kind": F.lit("line"), "col": F.lit(0), "item_no": F.col("line_no"), "body": F.lit(11.0), "col_left": F.lit(72.0), "col_right": F.lit(1080.0), "col_width": F.lit(468.0), "pitch": F.lit(14.0)}
    return layout.heading_levels(rows.withColumns(fixed)).select("doc_id", "page", "line_no", "level")


@query(f"""WITH {LINES_SQL}, h AS (SELECT doc_id, idx, 1 + n % 3 AS level FROM lines)
SELECT a.doc_id, a.idx, a.level, max(b.idx) AS parent FROM h a LEFT JOIN h b ON a.doc_id = b.doc_id AND b.idx < a.idx AND b.level < a.level GROUP BY a.doc_id, a.idx, a.level""")
def toc_tree(spark, sf):
    rows = adapter.text_lines(table(spark, sf, "documents")).select("doc_id", "idx", (1 + F.col("n") % 3).alias("level"))
    return toc.parents(rows, "doc_id", "idx", "level")


@query(f"""WITH {LINES_SQL}, p AS (SELECT doc_id, page || '-' || n % 4 AS href, idx FROM lines), f AS (SELECT *, min(idx) OVER (PARTITION BY doc_id, href) AS first FROM p)
SELECT doc_id, idx, dense_rank() OVER (PARTITION BY doc_id ORDER BY first)::INT AS play_order FROM f""")
def toc_play_order(spark, sf):
    rows = adapter.text_lines(table(spark, sf, "documents")).select("doc_id", "idx", F.concat_ws("-", "page", F.col("n") % 4).alias("href"))
    return toc.play_order(rows, "doc_id", "idx", "href").select("doc_id", "idx", "play_order")


@query("""WITH RECURSIVE p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10)))))::INT AS no FROM documents),
s AS (SELECT doc_id, no, length(t) AS size, length(t) < 24 AS heading FROM p),
r AS (SELECT doc_id, no, 0 AS chunk, 200 + size AS held FROM s WHERE no = 0
  UNION ALL SELECT s.doc_id, s.no, CASE WHEN r.held + s.size > 2000 OR (s.heading AND r.held > 900) THEN r.chunk + 1 ELSE r.chunk END, CASE WHEN r.held + s.size > 2000 OR (s.heading AND r.held > 900) THEN s.size ELSE r.held + s.size END FROM r JOIN s ON s.doc_id = r.doc_id AND s.no = r.no + 1)
SELECT doc_id, no, chunk::INT AS chunk FROM r""")
def chunk_assign(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("no", "t"))
    return toc.chunks(lines.select("doc_id", "no", F.length("t").alias("size"), (F.length("t") < 24).alias("heading"), F.lit(200).alias("start")), 900, 2000)


@query(f"""WITH {LINES_SQL}, x AS (SELECT doc_id, page, list(struct_pack(a := x0, b := x1)) AS v, min(x0) AS l, max(x1) AS r, count(*) AS n FROM lines GROUP BY doc_id, page),
f AS (SELECT doc_id, page, k, v, l, r, n, l + greatest(1.0, r - l) * list_sum([0.35::DOUBLE] || [0.01::DOUBLE for i in range(k)]) AS x FROM x, (SELECT unnest(range(30)) AS k)),
c AS (SELECT *, len(list_filter(v, lambda b: b.a < x - 2 AND b.b > x + 2)) AS crossed FROM f),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY crossed, k) AS rank FROM c)
SELECT doc_id, page, l AS "left", r AS "right", CASE WHEN n >= 8 AND crossed <= 0.15 * n AND len(list_filter(v, lambda b: b.b <= x + 2)) >= 0.2 * n AND len(list_filter(v, lambda b: b.a >= x - 2)) >= 0.2 * n THEN x END AS gutter FROM b WHERE rank = 1""")
def gutter_scan(spark, sf):
    return layout.gutters(adapter.lines(table(spark, sf, "documents")))


@query(f"""WITH {LINES_SQL}, both_kinds AS (SELECT doc_id, page, line_no AS no, 'line' AS kind, y0 FROM lines UNION ALL SELECT doc_id, page, 0, 'figure', 240.0::DOUBLE FROM (SELECT DISTINCT doc_id, page FROM lines) WHERE page % 2 = 1)
SELECT doc_id, page, kind, no, row_number() OVER (PARTITION BY doc_id, page ORDER BY y0, kind DESC, no)::INT AS item_no FROM both_kinds""")
def reading_order(spark, sf):
    """Lines in one column, with figures between them."""
    docs = table(spark, sf, "documents")
    return layout.reading_order(adapter.lines(docs).withColumn("x1", F.lit(540.0)), adapter.boxes(docs)).select("doc_id", "page", "kind", "no", "item_no")


@query(f"WITH {LINES_SQL} SELECT doc_id, page, line_no FROM lines WHERE NOT (page % 2 = 1 AND conf < 75 AND (x0 + x1) / 2 BETWEEN 100 AND 400 AND (y0 + y1) / 2 BETWEEN 240 AND 380)")
def figure_text_anti(spark, sf):
    docs = table(spark, sf, "documents")
    return layout.outside_figures(adapter.lines(docs), adapter.boxes(docs)).select("doc_id", "page", "line_no")


@query(f"""WITH {LINES_SQL}, c AS (SELECT doc_id, page, line_no, y0, y1 FROM lines WHERE n % 6 = 1),
near AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY abs(y0 - 380), line_no) AS r FROM c WHERE page % 2 = 1 AND (abs(y0 - 380) < 44 OR abs(240 - y1) < 44))
SELECT doc_id, page, line_no FROM near WHERE r = 1""")
def nearest_caption(spark, sf):
    docs = table(spark, sf, "documents")
    rows = adapter.text_lines(docs)
    told = F.when(F.col("n") % 6 == 1, F.concat(F.lit("Figure 1. "), F.col("text"))).otherwise(F.lit("Plain."))
    lines = rows.withColumn("spans", F.transform("spans", lambda s: s.withField("text", told)))
    return layout.nearest_caption(adapter.boxes(docs), lines, rows.select("doc_id").distinct().withColumn("body", F.lit(11.0))).select("doc_id", "page", "line_no")


# Text functions


@query(r"""SELECT doc_id, len(regexp_extract_all(text, '([^.!?…]+(?:[.!?…]+["''”’)\]]*\s*|$)|[.!?…]+)'))::INT AS n_sentences FROM documents""")
def sentence_split(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(text.sentences(F.col("text"))).alias("n_sentences"))


@query("SELECT page_id, md5(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')) AS digest FROM pages")
def html_escape(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(text.xml_safe(F.col("html"))).alias("digest"))


@query(r"""WITH n AS (SELECT page_id, regexp_extract(url, '[^/]*$') || '_part-' || page_id || '.html' AS name FROM pages),
t AS (SELECT page_id, trim(regexp_replace(replace(replace(regexp_replace(name, '\.[A-Za-z0-9]{2,5}$', ''), '_', ' '), '-', CASE WHEN contains(name, '_') THEN '-' ELSE ' ' END), '\s+', ' ', 'g')) AS t FROM n)
SELECT page_id, upper(left(t, 1)) || substr(t, 2) AS title FROM t""")
def title_from_file_name(spark, sf):
    name = F.concat(F.regexp_extract("url", "[^/]*$", 0), F.lit("_part-"), F.col("page_id"), F.lit(".html"))
    return table(spark, sf, "pages").select("page_id", text.title_from_file_name(name).alias("title"))


@query(r"""SELECT item_id, trim(left(trim(trim(regexp_replace(regexp_replace(strip_accents(text || ' : *x?'), '[\x00-\x1F<>:/\\|?*"]', ' ', 'g'), ' +', ' ', 'g')), '. '), 120), '. ') AS base FROM benchmark""")
def safe_file_base(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", text.safe_file_base(F.concat("text", F.lit(" : *x?"))).alias("base"))


@query(r"""SELECT page_id, array_to_string([CASE WHEN regexp_matches(p, '^[0-9]') THEN lpad(length(regexp_replace(p, '^0+([0-9])', '\1'))::VARCHAR, 4, '0') || regexp_replace(p, '^0+([0-9])', '\1') ELSE p END for p in regexp_extract_all(lower(url), '[0-9]+|[^0-9]+')], '') AS sort_key FROM pages""")
def natural_sort(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.natural_key(F.col("url")).alias("sort_key"))


@query(r"""WITH n AS (SELECT page_id, lower(url || ['.pdf', '.docx', '.jpeg', '.txt', '.heic'][page_id % 5 + 1]) AS name FROM pages)
SELECT page_id, CASE WHEN name LIKE '%.pdf' THEN 'pdf' WHEN name LIKE '%.docx' THEN 'docx' WHEN regexp_matches(name, '\.(jpe?g|png|webp|gif|bmp|tiff?|hei[cf])$') THEN 'image' END AS kind FROM n""")
def kind_sniff(spark, sf):
    ending = F.element_at(F.array(*map(F.lit, (".pdf", ".docx", ".jpeg", ".txt", ".heic"))), (F.col("page_id") % 5 + 1).cast("int"))
    return table(spark, sf, "pages").select("page_id", text.kind_of(F.concat("url", ending)).alias("kind"))


@query(r"""SELECT item_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '[0-9]+', '', 'g'), '\b[ivxlcdm]+\b', '', 'g'), '[^\p{L}]+', ' ', 'g')) AS norm FROM benchmark""")
def header_normalise(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", text.norm_header(F.col("text")).alias("norm"))


@query("SELECT conv_id, turn, CASE WHEN length(t) > 120 THEN left(t, 117) || '…' ELSE t END AS label FROM (SELECT conv_id, turn, regexp_replace(trim(text), '\\s+', ' ', 'g') AS t FROM conversations)")
def toc_labels(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", text.toc_label(F.col("text")).alias("label"))


@query()
def html_blocks(spark, sf):
    rows = html.html_rows(table(spark, sf, "pages"), "page_id", "html")
    return rows.select(F.col("doc_id").alias("page_id"), "part", "no", "kind", "level", text.plain_text(F.col("content")).alias("text"), F.size("items").alias("n_items"))


# Identity and duplicates


@query("SELECT doc_id, md5(text) AS key FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS n FROM documents) WHERE n > 1")
def exact_duplicates(spark, sf):
    """Later copies of a text. The first of each is found by aggregation, so that no group meets in one task."""
    docs = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("key"))
    first = docs.groupBy("key").agg(F.min("doc_id").alias("first"))
    return docs.join(first, "key").where("doc_id > first").select("doc_id", "key")


def _crc_sql(data: str) -> str:
    """CRC-32 of a list of bytes, by its bits: a byte is mixed in, then eight shifts."""
    step = "CASE WHEN b >= 0 THEN xor(c, b) ELSE xor(c >> 1, (c & 1) * 3988292384) END"
    return f"lower(to_hex(xor(list_reduce([4294967295] || flatten([[b, -1, -1, -1, -1, -1, -1, -1, -1] for b in {data}]), lambda c, b: {step}), 4294967295)))"


@query(f"""WITH h AS (SELECT doc_id, hex(encode(text)) AS h, octet_length(encode(text)) AS n FROM documents),
b AS (SELECT doc_id, n, [('0x' || substr(h, 2 * i - 1, 2))::BIGINT for i in range(1, n + 1)] AS b FROM h)
SELECT doc_id, n || ':' || {_crc_sql("b[1:65536]")} || ':' || {_crc_sql("b[greatest(65536, n - 65536) + 1 :]")} AS fingerprint FROM b""")
def content_fingerprint(spark, sf):
    return table(spark, sf, "documents").select("doc_id", hashing.fingerprint(F.encode("text", "UTF-8")).alias("fingerprint"))


@query("SELECT conv_id, md5(string_agg(md5(text), ';' ORDER BY md5(text))) AS key FROM conversations GROUP BY conv_id")
def source_key(spark, sf):
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.md5(hashing.source_key(F.collect_list(F.md5("text")))).alias("key"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unlabelled_documents(spark, sf):
    stored = table(spark, sf, "documents").select(F.col("doc_id").alias("key"))
    return bundle.garbage(stored, table(spark, sf, "labels").select(F.col("doc_id").alias("key"))).select(F.col("key").alias("doc_id"))


@query("SELECT d.doc_id, coalesce(l.quality = 0, false) AS review FROM documents d LEFT JOIN labels l USING (doc_id)")
def low_quality_flag(spark, sf):
    low = table(spark, sf, "labels").select("doc_id", (F.col("quality") == 0).alias("low"))
    return table(spark, sf, "documents").join(low, "doc_id", "left").select("doc_id", F.coalesce("low", F.lit(False)).alias("review"))


# Lists


@query("SELECT trim(source) AS course, min(doc_id) AS first_seq, count(*)::BIGINT AS n FROM documents GROUP BY trim(source)")
def course_order(spark, sf):
    return bundle.courses(table(spark, sf, "documents").select(F.col("source").alias("course"), F.col("doc_id").alias("seq")))


@query("""SELECT n_nationkey AS id, row_number() OVER (ORDER BY first, n_nationkey)::INT - 1 AS place FROM (SELECT n_nationkey, min(n_nationkey) OVER (PARTITION BY n_regionkey) AS first FROM nation)""")
def reading_list_order(spark, sf):
    listed = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_nationkey").alias("seq"), F.col("n_regionkey").cast("string").alias("course"))
    return bundle.ordered(listed).select("id", "place")


@query("""WITH r AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'queued' ELSE 'error' END AS status FROM orders), low AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_quantity < 5)
SELECT count(*)::BIGINT AS total, count(*) FILTER (WHERE status = 'done')::BIGINT AS done, count(*) FILTER (WHERE status = 'queued')::BIGINT AS waiting, count(*) FILTER (WHERE status = 'error')::BIGINT AS failed, count(*) FILTER (WHERE status = 'done' AND low.id IS NOT NULL)::BIGINT AS review FROM r LEFT JOIN low USING (id)""")
def queue_counters(spark, sf):
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "queued").otherwise("error")
    readings = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), status.alias("status"))
    pages = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.when(F.col("l_quantity") < 5, 50).otherwise(90).alias("confidence"))
    return bundle.counters(readings, pages)


@query("""WITH e AS (SELECT l_orderkey AS doc_id, CASE WHEN l_partkey % 3 = 0 THEN '' ELSE (l_linenumber + 40)::VARCHAR END AS label, l_linenumber AS page FROM lineitem),
x AS (SELECT doc_id, arg_min(label, page) FILTER (WHERE label <> '') AS a, arg_max(label, page) FILTER (WHERE label <> '') AS b FROM e GROUP BY doc_id)
SELECT doc_id, CASE WHEN a IS NULL THEN '' WHEN a = b THEN 'p. ' || a ELSE 'pp. ' || a || '–' || b END AS range FROM x""")
def page_range(spark, sf):
    label = F.when(F.col("l_partkey") % 3 == 0, "").otherwise((F.col("l_linenumber") + 40).cast("string"))
    return bundle.page_ranges(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page"), label.alias("label")))


@query("""WITH p AS (SELECT l_orderkey AS doc_id, l_linenumber AS page, CASE WHEN l_partkey % 3 = 0 THEN '' ELSE 'x' || l_linenumber END AS label FROM lineitem)
SELECT a.doc_id, a.page, CASE WHEN p.label IS NULL OR p.label = '' THEN (a.page + 1)::VARCHAR ELSE p.label END AS label FROM (SELECT l_orderkey AS doc_id, l_linenumber + 1 AS page FROM lineitem) a LEFT JOIN p USING (doc_id, page)""")
def page_label_lookup(spark, sf):
    items = table(spark, sf, "lineitem")
    pages = items.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page"), F.when(F.col("l_partkey") % 3 == 0, "").otherwise(F.concat(F.lit("x"), "l_linenumber")).alias("label"))
    return bundle.label_lookup(items.select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") + 1).alias("page")), pages).select("doc_id", "page", "label")


@query("""WITH b AS (SELECT conv_id AS doc_id, turn, CASE WHEN turn % 3 = 2 THEN -1 ELSE turn END AS page, text FROM conversations),
every AS (SELECT DISTINCT conv_id AS doc_id, turn AS page FROM conversations UNION SELECT doc_id, page FROM b)
SELECT e.doc_id, e.page, count(b.turn)::BIGINT AS n_blocks, coalesce(sum(length(b.text)), 0)::BIGINT AS n_chars FROM every e LEFT JOIN b ON b.doc_id = e.doc_id AND b.page = e.page GROUP BY e.doc_id, e.page""")
def review_groups(spark, sf):
    talks = table(spark, sf, "conversations")
    inline = F.array(F.struct(F.lit("text").alias("t"), F.col("text")))
    made = talks.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("block_no"), F.lit("paragraph").alias("kind"), F.when(F.col("turn") % 3 != 2, F.col("turn")).alias("page"), inline.alias("content"))
    groups = bundle.review_groups(talks.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page")), made)
    chars = F.aggregate("blocks", F.lit(0).cast("long"), lambda n, b: n + F.length(b["text"]))
    return groups.select("doc_id", "page", F.coalesce(F.size("blocks"), F.lit(0)).cast("long").alias("n_blocks"), F.coalesce(chars, F.lit(0).cast("long")).alias("n_chars"))


@query("SELECT n_nationkey AS id, CASE WHEN n_nationkey = 3 THEN 11 WHEN n_nationkey BETWEEN 3 AND 11 THEN n_nationkey - 1 ELSE n_nationkey END::INT AS seq FROM nation")
def list_move(spark, sf):
    return bundle.moved(table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_nationkey").alias("seq")), 3, 11)


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE 'old' END AS title, CASE WHEN o_orderkey % 2 = 1 THEN 'kept' WHEN o_orderkey % 3 = 0 THEN 'found' ELSE '' END AS author,
CASE WHEN o_orderkey % 3 = 1 THEN 'queued' WHEN o_orderkey % 3 = 2 THEN 'error' ELSE 'done' END AS status FROM orders""")
def merge_results(spark, sf):
    k = F.col("o_orderkey")
    orders = table(spark, sf, "orders")
    readings = orders.select(k.alias("id"), F.lit("old").alias("title"), F.when(k % 2 == 1, "kept").otherwise("").alias("author"), F.lit("queued").alias("status"), F.lit(0.0).alias("progress"), F.lit(None).cast("string").alias("message"))
    results = orders.where(k % 3 != 1).select(k.alias("id"), F.lit("new").alias("new_title"), F.when(k % 3 == 0, "found").alias("new_author"), F.when(k % 3 == 0, "old").otherwise("other").alias("auto_title"), F.when(k % 3 == 0, 5).otherwise(0).alias("n_blocks"), F.lit(None).cast("string").alias("error"))
    return bundle.merged_results(readings, results).select("id", "title", "author", "status")


@query("""WITH u AS (SELECT l_orderkey AS doc_id, l_partkey AS page, min(l_linenumber) AS no FROM lineitem GROUP BY l_orderkey, l_partkey) SELECT doc_id, page, no FROM u""")
def first_page_markers(spark, sf):
    marks = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("page"), F.col("l_linenumber").alias("no"))
    return toc.first_markers(marks, "doc_id", "page", "no")


@query(f"""WITH {LINES_SQL}, x AS (SELECT doc_id, page, floor((n % 97)::DOUBLE / 10 * 2 + 0.5) / 2 AS half, line_no AS first, n AS w FROM lines),
g AS (SELECT doc_id, page, half, sum(w) AS n, min(first) AS first FROM x GROUP BY doc_id, page, half)
SELECT doc_id, page, half AS size FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY n DESC, first) AS r FROM g) WHERE r = 1""")
def dominant_font_size(spark, sf):
    items = adapter.text_lines(table(spark, sf, "documents")).select("doc_id", "page", ((F.col("n") % 97).cast("double") / 10).alias("size"), F.col("line_no").alias("item_no"), F.col("text").alias("str"))
    return pdf_items.dominant_sizes(items)


# Rendering


#: Each document's reading as the SQL sees it: pieces of markup, dealt into files by the same limits.
_RENDERED_SQL = rf"""{LINES_SQL},
e AS (SELECT doc_id, 'r' || printf('%02d', doc_id::BIGINT + 1) AS r, idx, page, n, text, replace(replace(replace(replace(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS t,
  row_number() OVER (PARTITION BY doc_id, page ORDER BY idx) = 1 AS opens, sum(CASE WHEN n < 12 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY idx) AS h FROM lines),
m AS (SELECT *, CASE WHEN opens THEN '<span class="pg" epub:type="pagebreak" role="doc-pagebreak" id="' || r || '-pg' || (page + 1) || '" title="' || (page + 1) || '" aria-label="' || (page + 1) || '">[p.&#160;' || (page + 1) || ']</span>' ELSE '' END AS mark,
  regexp_replace(t, '\s{{2,}}', ' ', 'g') AS body FROM e),
html AS (SELECT *, CASE WHEN n < 12 THEN CASE WHEN opens THEN '<p class="pgline">' || mark || '</p>' || chr(10) ELSE '' END || '<h2 id="' || r || '-h' || h || '">' || body || '</h2>'
  WHEN opens OR trim(body) <> '' THEN '<p>' || mark || CASE WHEN opens AND trim(body) <> '' THEN ' ' ELSE '' END || trim(body) || '</p>' ELSE '' END AS html FROM m),
piece AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS k FROM html WHERE html <> ''),
head AS (SELECT doc_id::VARCHAR AS doc_id, 'r' || printf('%02d', doc_id + 1) AS r, '<header class="reading-head">' || chr(10) || CASE WHEN coalesce(source, '') <> '' THEN '<p class="course">' || source || '</p>' || chr(10) ELSE '' END || '<h1 id="r' || printf('%02d', doc_id + 1) || '-title">Document ' || doc_id || '</h1>' || chr(10)
  || '<p class="source">' || doc_id || '.txt</p>' || chr(10) || '</header>' || chr(10) AS head FROM documents),
dealt AS (SELECT p.doc_id, p.k, 1 AS seq, length(head) + length(p.html) AS size FROM piece p JOIN head USING (doc_id) WHERE p.k = 1
  UNION ALL SELECT p.doc_id, p.k, d.seq + CASE WHEN d.size + length(p.html) > 250000 OR (p.n < 12 AND d.size > 120000) THEN 1 ELSE 0 END, CASE WHEN d.size + length(p.html) > 250000 OR (p.n < 12 AND d.size > 120000) THEN 0 ELSE d.size END + length(p.html)
  FROM dealt d JOIN piece p ON p.doc_id = d.doc_id AND p.k = d.k + 1),
body AS (SELECT h.doc_id, h.r, coalesce(seq, 1) AS seq, CASE WHEN coalesce(seq, 1) = 1 THEN any_value(head) ELSE '' END || coalesce(string_agg(html, chr(10) ORDER BY p.k), '') AS body
  FROM head h LEFT JOIN dealt USING (doc_id) LEFT JOIN piece p ON p.doc_id = h.doc_id AND p.k = dealt.k GROUP BY h.doc_id, h.r, coalesce(seq, 1)),
file AS (SELECT doc_id, seq::INT AS seq, 'text/' || r || '-' || printf('%02d', seq) || '.xhtml' AS path, array_to_string(['<?xml version="1.0" encoding="utf-8"?>', '<!DOCTYPE html>', '<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops" lang="en" xml:lang="en">',
  '<head><meta charset="utf-8"/><title>Document ' || doc_id || '</title><link rel="stylesheet" type="text/css" href="../css/style.css"/></head>', '<body>' || chr(10) || body || chr(10) || '</body>', '</html>' || chr(10)], chr(10)) AS text FROM body)"""


def _as_readings(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Every document as a reading of one paragraph a line. Places come from the ids, so that nothing is numbered in one task."""
    docs = table(spark, sf, "documents")
    readings = docs.select(F.col("doc_id").cast("string").alias("id"), F.col("doc_id").cast("int").alias("place"), F.concat(F.lit("Document "), "doc_id").alias("title"), F.lit("").alias("author"), F.col("source").alias("course"), F.concat("doc_id", F.lit(".txt")).alias("file_name"))
    rows = adapter.text_lines(docs)
    inline = "struct<t:string,text:string,i:boolean,b:boolean,sup:boolean,note:string,page:int>"
    run = F.struct(F.lit("text").alias("t"), F.col("text"), F.lit(False).alias("i"), F.lit(False).alias("b"), F.lit(False).alias("sup"), F.lit(None).cast("string").alias("note"), F.lit(None).cast("int").alias("page"))
    made = rows.select("doc_id", F.col("idx").alias("block_no"), F.when(F.col("n") < 12, "heading").otherwise("paragraph").alias("kind"), F.when(F.col("n") < 12, 1).alias("level"), "page", F.array(run).cast(f"array<{inline}>").alias("content"))
    return readings, spark.createDataFrame([], struct(BLOCKS)).unionByName(made, allowMissingColumns=True), spark.createDataFrame([], struct(NOTES)), adapter.layouts(docs).withColumn("label", F.lit(""))


@query(f"WITH RECURSIVE {_RENDERED_SQL} SELECT doc_id, seq, path, length(text)::INT AS n_chars, md5(text) AS digest FROM file")
def xhtml_render(spark, sf):
    rows = render.rendered(*_as_readings(spark, sf), None, BundleSettings())
    return rows.where("part = 'file'").select("doc_id", "seq", "path", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


@query(f"""WITH RECURSIVE {_RENDERED_SQL}, part AS (SELECT 'file' AS part, doc_id FROM file UNION ALL SELECT 'toc', doc_id FROM head UNION ALL SELECT 'toc', doc_id FROM piece WHERE n < 12 AND trim(text) <> '' UNION ALL SELECT 'page', doc_id FROM piece WHERE opens)
SELECT part, count(*)::BIGINT AS n, count(DISTINCT doc_id)::BIGINT AS n_readings FROM part GROUP BY part""")
def bundle_manifest(spark, sf):
    rows = render.rendered(*_as_readings(spark, sf), None, BundleSettings())
    return rows.groupBy("part").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_readings"))
