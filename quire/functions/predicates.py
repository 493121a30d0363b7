"""Predicates and classes of paragraphs as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.mathtext import MISSING, display_equation
from quire.functions.text import WS, normal, strip

#: Patterns of furniture, numbered sections, captions, headings of references and abstracts; words of pseudocode.
FURNITURE = r"(?i)^(arxiv:|https?://|www\.|doi:|©|copyright|[0-9]{1,4}$|[0-9]+\s*\|\s*page|proceedings of|downloaded from)"
SECTION = r"^([0-9]+(\.[0-9]+)*\.?|[A-Z]\.)[ \t]+[^ \t]"
CAPTION = r"(?i)^(figure|fig\.|table|algorithm|listing|scheme|eq\.)[ \t]*[0-9]+"
REFERENCES = r"(?i)^(references|bibliography|参考文献)$"
ABSTRACT = r"(?i)^(abstract|摘要)([^A-Za-z0-9_]|$)"
KEYWORDS = ("for", "foreach", "while", "if", "then", "do", "return", "elif", "else", "←", "<-")


def is_furniture(x: Column) -> Column:
    return x.rlike(FURNITURE)


def caption_kind(x: Column) -> Column:
    bare = F.regexp_replace(x, r"^[0-9 \t.,%)-]+", "")
    return F.when(bare.rlike(r"(?i)^(table|表)[ \t]*[0-9]+[ \t]*[:：.]"), "table").when(bare.rlike(r"(?i)^(figure|fig\.?|图)[ \t]*[0-9]+[ \t]*[:：.]"), "figure")


def figure_label(x: Column) -> Column:
    t = normal(x)
    return F.length(t).between(1, 180) & ~t.rlike(r"[.!?] +[A-Z]")


def glyph_only(x: Column) -> Column:
    rest = F.regexp_replace(F.replace(x, F.lit(MISSING), F.lit("")), r"[\s.,;:!?()\[\]{}<>|/\\$~^_+\-=*]+", "")
    return x.contains(MISSING) & (rest == "") & (F.length(strip(x)) <= 12)


def tick_junk(x: Column) -> Column:
    t = strip(x)
    return (t == "") | (~t.rlike(r"[A-Za-z\x{4e00}-\x{9fff}]") & t.rlike(r"^[0-9. \t,\x{2013}\x{2014}:/()-]+$"))


def numeric_dominant(x: Column) -> Column:
    words = F.filter(F.split(x, f"{WS}+"), lambda w: w != "")
    numbers = F.filter(words, lambda w: w.rlike(r"^[0-9.,%+-]+$"))
    return (F.size(words) > 0) & (2 * F.size(numbers) >= F.size(words))


def pseudocode_score(lines: Column) -> Column:
    joined = F.lower(F.array_join(lines, " "))
    numbered = F.size(F.filter(lines, lambda x: strip(F.substring(strip(x), 1, 3)).rlike("^[0-9]+$")))
    hits = sum((joined.contains(k).cast("int") for k in KEYWORDS), F.lit(0))
    return F.when(F.substring(joined, 1, 80).contains("algorithm"), 3).otherwise(0) + F.when(numbered >= 3, 2).otherwise(0) + F.when(hits >= 3, 2).otherwise(0) + F.when(joined.contains("input:") & joined.contains("output:"), 1).otherwise(0)


def line_kind(x: Column, in_references: Column) -> Column:
    """Class of a paragraph by its text alone; in_references says whether a references heading came before."""
    t = strip(x)
    short = F.length(t) < 90
    heading = short & t.rlike(SECTION) & ~t.rlike(r"[.。:]$")
    return F.when(in_references & ~t.rlike(REFERENCES), "reference").when(t.rlike(REFERENCES), "heading").when(t.rlike(ABSTRACT), "abstract").when(t.rlike(CAPTION), "caption").when(heading, "heading").otherwise("text")


def block_kind(x: Column, size: Column, body: Column, bold: Column, page: Column, in_references: Column) -> Column:
    """Class and level of a block by its text, its size against the body's, its face and its page, as a struct (kind, level).

    References after their heading, display equations, abstracts, captions no larger than the body, then short blocks
    that are larger or bold: a title on the first page, numbered and other headings. Level 2 is for bold headings and
    numbers with a stop.
    """
    t = strip(x)
    tail = F.regexp_replace(F.regexp_replace(t, r"\$[\^_]\{[^}]*\}\$", ""), r"\s+$", "")
    short, section = F.length(t) < 90, t.rlike(SECTION)
    candidate = short & ((size >= 1.14 * body) | (bold & (size >= 0.98 * body)))
    numbered = F.when(F.regexp_extract(t, r"^(\S+)", 1).contains("."), 2).otherwise(1)
    kind = lambda k, level=0: F.struct(F.lit(k).alias("kind"), (level if isinstance(level, Column) else F.lit(level)).alias("level"))
    return (
        F.when(in_references & ~t.rlike(REFERENCES), kind("reference"))
        .when(t.rlike(REFERENCES), kind("heading", 1))
        .when(display_equation(x), kind("equation"))
        .when(t.rlike(ABSTRACT), kind("abstract"))
        .when(t.rlike(CAPTION) & (size <= 1.02 * body), kind("caption"))
        .when(candidate & (size >= 1.6 * body) & (page == 1), kind("title"))
        .when(candidate & section & ~tail.rlike("[.。:,]$"), kind("heading", numbered))
        .when(candidate & (size >= 1.15 * body), kind("heading", 1))
        .when(candidate & bold & ~tail.rlike("[.。:]$"), kind("heading", 2))
        .when(short & section & ~tail.rlike("[.。:]$"), kind("heading", numbered))
        .otherwise(kind("text"))
    )


def page_number(x: Column, lines: Column, width: Column, page_width: Column) -> Column:
    """A single narrow line of one to four digits or Roman numerals."""
    return x.rlike("^[0-9IVXivx]{1,4}$") & (lines == 1) & (width < 0.12 * page_width)
