"""Inline content as text to edit, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.inline import inline
from quire.functions.text import WS, collapsed, page_label, trimmed
from quire.saving import saved
from quire.shipping import ship

#: The tokens that stand in a text to edit for references and page breaks.
TOKEN = rf"⟦{WS}*(note|p\.){WS}*([^⟧]*?){WS}*⟧"


def editable(content: Column, markers: Column, labels: Column) -> Column:
    """Text with ⟦note 1⟧ and ⟦p. 47⟧ for references and page breaks. markers: map of note id to marker; labels: of page to label."""

    def one(c: Column) -> Column:
        marker = F.element_at(markers, c["note"])
        return (
            F.when(c["t"] == "text", c["text"])
            .when(c["t"] == "noteref", F.coalesce(F.concat(F.lit("⟦note "), marker, F.lit("⟧")), F.lit("")))
            .otherwise(F.concat(F.lit(" ⟦p. "), page_label(F.element_at(labels, c["page"]), c["page"]), F.lit("⟧ ")))
        )

    return F.trim(F.regexp_replace(F.array_join(F.transform(content, one), ""), " {2,}", " "))


def apply_edits(blocks: DataFrame, edits: DataFrame, notes: DataFrame, pages: DataFrame) -> DataFrame:
    """blocks with the texts of edits (doc_id, block_no, text; one a block) in place of what they showed.

    A text that is as it was shown gives the content before. Else styles are lost, and each token is looked up: first among the notes or pages that the block
    itself had, in order, then among the document's, by page and number. Tokens that name nothing vanish. A null text is an empty one. Edits without a block
    are left out. Tokens, references, notes and pages meet as rows, by equi-joins on their names; no row holds a document's.
    """
    keys = ["doc_id", "block_no"]
    hit = saved(blocks.join(edits.select(*keys, F.coalesce("text", F.lit("")).alias("_text")), keys))
    own = _own_names(hit, notes, pages)
    pairs = lambda t, field: F.map_from_entries(F.array_distinct(F.transform(F.filter("_own", lambda x: x["t"] == t), lambda x: F.struct(x[field], x["name"]))))
    shown = editable(F.coalesce("content", F.array()), pairs("noteref", "note"), pairs("pb", "page"))
    read = hit.join(own, keys, "left").withColumn("_own", F.coalesce("_own", F.array())).withColumn("_same", shown == trimmed(F.col("_text")))
    found = _resolved(read.where(~F.col("_same")), notes, pages)
    changed = read.join(found, keys, "left").withColumn("content", F.when(F.col("_same"), F.coalesce("content", F.array())).otherwise(_rebuilt()))
    return blocks.join(edits.select(*keys).distinct(), keys, "left_anti").unionByName(changed.select(*blocks.columns))


def _own_names(hit: DataFrame, notes: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, block_no, _own: the references and page breaks of each block in order, with their names; notes that are gone have none."""
    refs = hit.select("doc_id", "block_no", F.posexplode("content").alias("i", "c")).select("doc_id", "block_no", "i", F.col("c.t").alias("t"), F.col("c.note").alias("note"), F.col("c.page").alias("page")).where("t <> 'text'")
    markers = notes.groupBy("doc_id", F.col("id").alias("note")).agg(F.max_by("marker", F.struct("page", "note_no")).alias("_marker"))
    labels = pages.groupBy("doc_id", "page").agg(F.max("label").alias("_label"))
    named = refs.join(markers, ["doc_id", "note"], "left").join(labels, ["doc_id", "page"], "left")
    name = F.when(F.col("t") == "noteref", F.col("_marker")).otherwise(page_label(F.col("_label"), F.col("page")))
    told = named.withColumn("name", name).where(F.col("name").isNotNull())
    return told.groupBy("doc_id", "block_no").agg(F.sort_array(F.collect_list(F.struct("i", "t", "note", "page", "name"))).alias("_own"))


def _resolved(edited: DataFrame, notes: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, block_no, _found: map from a token's place in the text to the note or page that it names."""
    tokens = F.arrays_zip(*(F.regexp_extract_all("_text", F.lit(TOKEN), F.lit(k)).alias(n) for k, n in ((1, "kind"), (2, "name"))))
    rows = edited.select("doc_id", "block_no", "_own", F.posexplode(tokens).alias("k", "token")).select("doc_id", "block_no", "_own", "k", F.when(F.col("token.kind") == "note", "noteref").otherwise("pb").alias("t"), F.col("token.name").alias("name"))
    had = F.get(F.filter("_own", lambda x: (x["t"] == F.col("t")) & (x["name"] == F.col("name"))), 0)
    rows = rows.withColumn("had", had).drop("_own")
    first_note = notes.groupBy("doc_id", F.lit("noteref").alias("t"), F.col("marker").alias("name")).agg(F.min_by("id", F.struct("page", "note_no")).alias("any_note"), F.lit(None).cast("int").alias("any_page"))
    first_page = pages.groupBy("doc_id", F.lit("pb").alias("t"), page_label(F.col("label"), F.col("page")).alias("name")).agg(F.lit(None).cast("string").alias("any_note"), F.min("page").alias("any_page"))
    met = rows.join(first_note.unionByName(first_page), ["doc_id", "t", "name"], "left")
    named = met.select("doc_id", "block_no", "k", F.coalesce("had.note", "any_note").alias("note"), F.coalesce("had.page", "any_page").alias("page")).where("coalesce(note, string(page)) is not null")
    return named.groupBy("doc_id", "block_no").agg(F.map_from_entries(F.collect_list(F.struct("k", F.struct("note", "page")))).alias("_found"))


def _rebuilt() -> Column:
    """Content from _text and _found."""

    def piece(x: Column, k: Column) -> Column:
        token = F.element_at("_found", k)
        run = F.when(x != "", F.array(inline("text", collapsed(x)))).otherwise(F.array())
        named = F.when(token["note"].isNotNull(), F.array(inline("noteref", note=token["note"]))).when(token["page"].isNotNull(), F.array(inline("pb", page=token["page"]))).otherwise(F.array())
        return F.concat(run, named)

    runs = F.flatten(F.transform(F.split("_text", TOKEN, -1), piece))
    # blanks at either end of the whole go
    last = F.size(runs) - 1
    ended = lambda c, k: F.when((k == last) & (c["t"] == "text"), c.withField("text", F.rtrim(c["text"]))).otherwise(c)
    begun = lambda c, k: F.when((k == 0) & (c["t"] == "text"), c.withField("text", F.ltrim(c["text"]))).otherwise(c)
    return F.filter(F.transform(F.transform(runs, begun), ended), lambda c: (c["t"] != "text") | (c["text"] != ""))


def caption_set(blocks: DataFrame, doc_id: str, block_no: int, caption: str) -> DataFrame:
    hit = (F.col("doc_id") == doc_id) & (F.col("block_no") == block_no)
    return blocks.withColumn("caption", F.when(hit, F.nullif(F.trim(F.lit(caption)), F.lit(""))).otherwise(F.col("caption")))


def note_set(notes: DataFrame, doc_id: str, note: str, text: str) -> DataFrame:
    """notes with one's content replaced by plain text."""
    run = F.struct(F.lit("text").alias("t"), F.lit(" ".join(text.split())).alias("text"), *(F.lit(False).alias(k) for k in ("i", "b", "sup")), F.lit(None).cast("string").alias("note"), F.lit(None).cast("int").alias("page"))
    hit = (F.col("doc_id") == doc_id) & (F.col("id") == note)
    return notes.withColumn("content", F.when(hit, F.array(run)).otherwise(F.col("content")))


ship(__name__)
