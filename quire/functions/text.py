"""String functions on columns. All but two (marked) are built-in expressions and stay within code generation."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quire.shipping import ship

#: White space as browsers see it; Java's \s is ASCII only.
SPACES = "".join(map(chr, (*range(9, 14), 32, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288, 65279)))
#: The same as a class of ranges: one of single characters is tried one by one.
WS = "[" + "".join(chr(a) if a == b else f"{chr(a)}-{chr(b)}" for a, b in ((9, 13), (32, 32), (160, 160), (5760, 5760), (8192, 8202), (8232, 8233), (8239, 8239), (8287, 8287), (12288, 12288), (65279, 65279))) + "]"
#: A roman numeral below 4000, any case; empty input excluded.
ROMAN = r"(?i)^(?=[ivxlcdm])m{0,3}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$"
#: How a finished sentence ends.
TERMINAL = r"[.!?:;\"”’)\]…]$"
#: The start of a note: junk, marker, separator.
NOTE_START = WS + r"*[~_=·•'`\"]?" + WS + r"*(\d{1,3}|[*†‡§¶])(?:[.)]" + WS + r"*|" + WS + r"+)(?=\S)"
#: The start of a caption.
CAPTION = r"(?i)^(fig(ure)?|table|chart|map|plate|exhibit|illustration|graph)\.?\s*[\dIVX]"
#: Extensions of images.
IMAGE_EXTENSIONS = "jpe?g|png|webp|gif|bmp|tiff?|hei[cf]"


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def collapsed(c: Column) -> Column:
    return F.regexp_replace(c, f"{WS}+", " ")


def line_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: s["text"]), "")


def plain_text(content: Column) -> Column:
    """Text of inline content; note references and page breaks have none."""
    return F.array_join(F.transform(F.filter(content, lambda c: c["t"] == "text"), lambda c: c["text"]), "")


def bigrams(x: Column) -> Column:
    """A text's bigrams, each with the number of its occurrence, so that no two are equal; none for a text shorter than 2 characters."""

    def let(value: Column, use) -> Column:
        return F.get(F.transform(F.array(value), use), F.lit(0))

    def numbered(grams: Column) -> Column:
        n = F.size(grams)

        def runs(starts: Column) -> Column:
            every = lambda start, k: F.transform(F.sequence(F.lit(1), F.coalesce(F.get(starts, k + 1), n) - start), lambda i: F.concat(F.get(grams, start), i.cast("string")))
            return F.flatten(F.transform(starts, every))

        return let(F.filter(F.sequence(F.lit(0), n - 1), lambda k: (k == 0) | (F.get(grams, k) != F.get(grams, k - 1))), runs)

    chars = F.regexp_extract_all(x, F.lit("(?s)."), F.lit(0))
    pairs = let(chars, lambda c: F.sort_array(F.transform(F.sequence(F.lit(0), F.size(c) - 2), lambda k: F.concat(F.get(c, k), F.get(c, k + 1)))))
    return F.when(F.length(x) >= 2, let(pairs, numbered)).otherwise(F.array().cast("array<string>"))


def dice(a: Column, b: Column) -> Column:
    """Similarity by bigrams, counted with repeats: twice the common ones over all. Equal texts 1, else shorter than 2 characters 0."""
    counted = 2.0 * F.size(F.array_intersect(bigrams(a), bigrams(b))) / (F.length(a) + F.length(b) - 2)
    return F.when(a == b, 1.0).when((F.length(a) < 2) | (F.length(b) < 2), 0.0).otherwise(counted)


def norm_header(c: Column) -> Column:
    """Letters of a header line, without digits and roman numerals, for comparison between pages."""
    bare = F.regexp_replace(F.lower(c), r"[0-9]+", "")
    bare = F.regexp_replace(bare, r"(?<![A-Za-z0-9_])[ivxlcdm]+(?![A-Za-z0-9_])", "")
    return F.trim(F.regexp_replace(bare, r"[^\p{L}]+", " "))


def page_number(c: Column) -> Column:
    """The page number that a line begins or ends with: arabic without leading zeros, roman in lower case; else null.

    A roman number counts only in a line of at most 4 characters or beside another letter of the alphabet.
    """
    t = F.regexp_replace(trimmed(c), f"^(?:{WS}|[-–—])+|(?:{WS}|[-–—])+$", "")
    number = r"([0-9]{1,4}|[ivxlcdm]{1,7})"
    head = F.regexp_extract(t, rf"(?i)^(?:page{WS}+)?{number}(?={WS}|$)", 1)
    tail = F.regexp_extract(t, rf"(?i)(?:^|{WS}){number}$", 1)

    def sound(x: Column) -> Column:
        others = F.length(F.regexp_replace(F.regexp_replace(t, "[^A-Za-z]", ""), "(?i)[ivxlcdm]", "")) > 0
        arabic = F.when(x.rlike("^[0-9]+$"), x.try_cast("int").cast("string"))
        return F.coalesce(arabic, F.when((x != "") & x.rlike(ROMAN) & ((F.length(t) <= 4) | others), F.lower(x)))

    return F.coalesce(sound(head), sound(tail))


def joined(prev: Column, following: Column) -> Column:
    """Two pieces of running text as one: a word that a hyphen breaks is made whole, else one space stands between."""
    broken = prev.rlike(r"\p{L}-$") & following.rlike(r"^\p{Ll}")
    loose = prev.rlike(f"{WS}$") | following.rlike(f"^{WS}") | (prev == "")
    return F.when(broken, F.concat(F.substring(prev, F.lit(1), F.length(prev) - 1), following)).when(loose, F.concat(prev, following)).otherwise(F.concat_ws(" ", prev, following))


def all_joined(pieces: Column) -> Column:
    return F.aggregate(pieces, F.lit(""), joined)


def title_from_file_name(name: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(name, r"\.[A-Za-z0-9]{2,5}$", ""), "_", " ")
    spaced = F.when(bare.contains(" "), F.regexp_replace(bare, r" +- +", " – ")).otherwise(F.regexp_replace(bare, "-", " "))
    t = trimmed(collapsed(spaced))
    return F.when(t == "", "Untitled reading").otherwise(F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, F.lit(2), F.length(t))))


def clean_title(title: Column) -> Column:
    """A document's own title, or null if it is a leftover of the program that wrote it."""
    t = trimmed(F.regexp_replace(F.regexp_replace(trimmed(title), r"(?i)^microsoft word - ", ""), r"(?i)\.(docx?|pdf|indd|qxd|rtf|txt|pptx?)$", ""))
    return F.when((F.length(t) >= 3) & ~t.rlike(r"(?i)^(untitled|document\d*|tmp|temp)"), t)


def xml_safe(c: Column) -> Column:
    """Without what XML can't hold, and with its special characters escaped."""
    clean = F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F" + chr(0xFFFE) + chr(0xFFFF) + "]", "")
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        clean = F.replace(clean, F.lit(raw), F.lit(entity))
    return clean


def padded(n: Column, width: int = 2) -> Column:
    """Zeros in front; longer numbers stay whole, unlike with lpad."""
    return F.format_string(f"%0{width}d", n)


def stable_id(*parts: Column) -> Column:
    """An id that a retried task makes again."""
    return F.sha2(F.concat_ws("\x1f", *(p.cast("string") for p in parts)), 256)


def match_key(c: Column) -> Column:
    """Letters and digits in lower case, for comparing titles."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def sentences(c: Column) -> Column:
    """The text in sentences with their closing marks and spaces, and marks that no sentence opens; joined they give the text again."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"([^.!?…]+(?:[.!?…]+[\"'”’)\]]*" + WS + r"*|$)|[.!?…]+)"), F.lit(1))


def toc_label(c: Column) -> Column:
    t = collapsed(trimmed(c))
    return F.when(F.length(t) > 120, F.concat(F.substring(t, 1, 117), F.lit("…"))).otherwise(t)


def bytes_text(n: Column) -> Column:
    mb = n / (1024 * 1024)
    return F.when(n < 1024 * 1024, F.format_string("%d KB", F.greatest(F.lit(1), F.floor(n / 1024 + 0.5)).cast("long"))).when(mb < 10, F.format_string("%.1f MB", mb)).otherwise(F.format_string("%d MB", F.floor(mb + 0.5).cast("long")))


def name_list(names: Column) -> Column:
    more = F.size(names) - 3
    first = F.array_join(F.slice(names, 1, 3), ", ")
    return F.when(more > 0, F.concat(first, F.format_string(" and %d more", more))).otherwise(first)


def cover_list(titles: Column, fit: int) -> Column:
    """As many titles as fit, and how many more there are."""
    more = F.size(titles) - fit
    return F.when(more > 0, F.concat(F.slice(titles, 1, fit), F.array(F.format_string("+ %d more", more)))).otherwise(titles)


def friendly_error(message: Column) -> Column:
    return (
        F.when(message.rlike("(?i)password"), "This PDF is protected by a password.")
        .when(message.rlike("(?i)invalid pdf|missing pdf|pdf structure"), "This PDF is damaged.")
        .when(message.rlike("(?i)zip|central directory"), "This is not a sound Word file.")
        .when(message.rlike("(?i)network|fetch"), "A file that is needed could not be loaded.")
        .otherwise(F.coalesce(F.when(message != "", message), F.lit("Something went wrong.")))
    )


def page_label(label: Column, page: Column) -> Column:
    """The printed label, else the page's ordinal; page counts from 0."""
    return F.coalesce(F.when(label != "", label), (page + 1).cast("string"))


def page_range(first: Column, last: Column) -> Column:
    return F.when(first.isNull() | (first == ""), "").when(first == last, F.concat(F.lit("p. "), first)).otherwise(F.concat(F.lit("pp. "), first, F.lit("–"), last))


def image_extension(mime: Column) -> Column:
    return F.when(mime == "image/png", "png").otherwise("jpg")


def natural_key(c: Column, width: int = 12) -> Column:
    """A key that sorts names as people do: case aside, runs of digits by value."""
    parts = F.regexp_extract_all(F.lower(c), F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))
    digits = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.concat(F.lpad(F.length(digits(p)).cast("string"), 4, "0"), digits(p))).otherwise(p)), "")


def kind_of(path: Column, mime: Column | None = None) -> Column:
    """pdf, docx, image or null, by MIME type or extension; earlier kinds win."""
    mime = F.lower(F.coalesce(mime, F.lit(""))) if mime is not None else F.lit("")
    name = F.lower(path)
    return (
        F.when((mime == "application/pdf") | name.endswith(".pdf"), "pdf")
        .when((mime == "application/vnd.openxmlformats-officedocument.wordprocessingml.document") | name.endswith(".docx"), "docx")
        .when(mime.startswith("image/") | name.rlike(rf"\.({IMAGE_EXTENSIONS})$"), "image")
    )


def font_style(name: Column) -> Column:
    return F.struct(name.rlike("(?i)bold|black|heavy|semibold|demi").alias("b"), name.rlike("(?i)oblique|italic").alias("i"))


@F.pandas_udf(StringType())
def safe_file_base(names: pd.Series) -> pd.Series:
    """A name that any file system takes (Python: NFKD has no built-in). At most 120 characters; empty if nothing is left."""
    plain = str.maketrans({"–": "-", "—": "-", "‘": "'", "’": "'", "“": "", "”": "", '"': "", "…": "...", **{c: " " for c in '<>:/\\|?*'}, **{chr(k): " " for k in range(32)}})

    def one(name: str | None) -> str:
        text = "".join(c for c in unicodedata.normalize("NFKD", (name or "").translate(plain)) if not unicodedata.combining(c))
        return " ".join(text.split()).strip(". ")[:120].strip(". ")

    return names.map(one)


def epub_file_name(chosen: Column, title: Column, kepub: Column) -> Column:
    """The name to save under: the user's, without an extension of ours, or one from the title; and the extension."""
    bare = F.regexp_replace(F.coalesce(chosen, F.lit("")), r"(?i)(\.kepub)?\.epub$", "")
    base = safe_file_base(bare)
    slug = F.regexp_replace(F.regexp_replace(safe_file_base(title), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")
    slug = F.regexp_replace(F.substring(slug, 1, 80), "-+$", "")
    stem = F.when(base != "", base).when(slug != "", slug).otherwise("readings")
    return F.concat(stem, F.when(kepub, ".kepub.epub").otherwise(".epub"))


@F.pandas_udf(StringType())
def tidy_heading(titles: pd.Series) -> pd.Series:
    """A heading fit for a list (Python: words are capitalized by what stands before them).

    What isn't an ASCII letter or digit goes at the start; a roman numeral after "chapter" and its like is mended and set in capitals; a heading all in capitals
    gets capitals at words' starts only, and in words that look like short roman numerals.
    """
    import re

    counted = re.compile(r"(chapter|part|book|section|lecture)\s+([IVXLCDM1l|](?:\s?[IVXLCDM1l|])*)(?=[\s.:]|$)", re.I)
    starts = re.compile(r"(?:^|(?<=[\s(“\"'-]))[^\W\d_]")
    roman = re.compile(r"\b[ivxlcdm]{1,5}\b", re.I | re.A)

    def one(title: str | None) -> str | None:
        if title is None:
            return None
        text = re.sub(r"^\W+", "", title, flags=re.A).strip()
        if m := counted.match(text):
            number = re.sub("[1l|]", "I", "".join(m[2].split())).upper()
            text = f"{m[1]} {number}{text[m.end():]}"
        letters = "".join(c for c in text if c.isalpha())
        if len(letters) > 3 and letters == letters.upper():
            text = starts.sub(lambda w: w[0].upper(), text.lower())
            text = roman.sub(lambda w: w[0].upper(), text)
        return text

    return titles.map(one)


ship(__name__)
