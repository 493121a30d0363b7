"""Scalars over text as Column expressions: normal forms, keys, escapes, slugs, tokens."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of both engines and the no-break space.
WS = r"[ \t\n\x0B\f\r\x{00A0}]"
BLANKS = " \t\n\x0b\f\r\xa0"

#: Prefixes of compounds that keep a hyphen at a line's end.
COMPOUNDS = (
    "state-of", "of-the", "trade-off", "tree-top", "multi-index", "multi-tier", "non-trivial", "non-colluding", "semi-honest",
    "end-to-end", "top-k", "knowledge-intensive", "resource-efficient", "memory-efficient", "cost-effective", "time-consuming",
    "real-world", "fine-grained", "co-design", "sub-linear", "sub-string", "cross-layer", "self-similar", "well-defined",
    "well-known", "high-dimensional", "low-latency", "client-side", "server-side", "read-only", "write-only", "two-party",
    "single-server", "multi-party", "public-key", "private-key", "hash-based", "graph-based", "tree-based", "index-based",
    "oram-based", "indistinguishability-based", "simulation-based", "game-based", "billion-scale", "million-scale",
    "near-neighbor", "nearest-neighbor", "round-trip", "point-lookup", "load-balancing", "batching-based",
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(x: Column) -> Column:
    return F.regexp_replace(x, f"^{WS}+|{WS}+$", "")


def normal(x: Column) -> Column:
    """White space collapsed and stripped."""
    return F.regexp_replace(F.regexp_replace(x, f"{WS}+", " "), "^ | $", "")


def furniture_key(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(strip(x)), "[0-9]+", "#"), f"{WS}+", " ")


def anchor(x: Column, n: int = 48) -> Column:
    return F.substring(normal(x), 1, n)


def plain_lower(x: Column) -> Column:
    """Each character's lower case by itself, of one character, whatever stands beside it."""
    return F.array_join(F.transform(F.regexp_extract_all(x, F.lit("(?s)."), F.lit(0)), lambda c: F.substring(F.lower(c), 1, 1)), "")


def slug(x: Column, most: int, empty: str, digits: int) -> Column:
    """ASCII letters and digits joined by hyphens, then the start of the text's md5."""
    core = F.substring(F.lower(F.regexp_replace(F.regexp_replace(x, "[^A-Za-z0-9]+", "-"), "^-+|-+$", "")), 1, most)
    return F.concat(F.when(core == "", F.lit(empty)).otherwise(core), F.lit("-"), F.substring(F.md5(x), 1, digits))


def safe_filename(x: Column, most: int = 60) -> Column:
    return F.substring(F.regexp_replace(x, r'[\\/:*?"<>|\x00-\x1F]+', "_"), 1, most)


def html_escape(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def embed_json(x: Column) -> Column:
    """JSON text that can stand inside a script element."""
    for a, b in (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026"), ("\u2028", "\\u2028"), ("\u2029", "\\u2029")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def mask(x: Column) -> Column:
    stars = F.repeat(F.lit("*"), F.greatest(F.lit(4), F.length(x) - 10))
    return F.concat(F.substring(x, 1, 6), stars, F.substring(x, -4, 4))


def squash(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), "[^a-z0-9]", "")


def strip_math(x: Column) -> Column:
    return F.regexp_replace(x, r"\$[^$]*\$", "")


def strip_inline(html: Column) -> Column:
    """Scripts go first, then styles; each ends at its own closing tag."""
    bare = F.regexp_replace(html, r"(?is)<script\b.*?</script>", "")
    return F.regexp_replace(bare, r"(?is)<style\b.*?</style>", "")


def tokens(x: Column, step_number: bool = False) -> Column:
    """Distinct identifiers and numbers of two characters or more, in lower case; with step_number, a number that the text begins with is none of it."""
    x = F.regexp_replace(x, r"^\s*\(?[0-9]+[.)]?\s+", "") if step_number else x
    found = F.transform(F.regexp_extract_all(x, F.lit(r"[A-Za-z_][A-Za-z0-9_]*|[0-9]+(?:\.[0-9]+)?"), F.lit(0)), F.lower)
    return F.array_distinct(F.filter(found, lambda t: F.length(t) >= 2))


def dedupe_pair(x: Column) -> Column:
    """A（A） or A(A) becomes A, whatever the case."""
    a, b = (F.regexp_extract(x, r"^\s*(.+?)\s*[（(]\s*(.+?)\s*[)）]\s*$", k) for k in (1, 2))
    return F.when((a != "") & (F.lower(a) == F.lower(b)), a).otherwise(x)


def page_bounds(spec: Column) -> Column:
    """'3-7' or '4' as a struct of first and last."""
    parts = F.split(spec, "-")
    first = F.get(parts, F.lit(0)).try_cast("int")
    return F.struct(first.alias("first"), F.coalesce(F.get(parts, F.lit(1)).try_cast("int"), first).alias("last"))


def join_lines(lines: Column, vocabulary: Column) -> Column:
    """Lines of a paragraph as one text.

    A hyphen at a line's end before a lower-case letter stays if the compound is in the vocabulary or among the
    fixed compounds, else the halves join.
    """
    known = F.array_union(vocabulary, F.array(*map(F.lit, COMPOUNDS)))

    def add(a: Column, x: Column) -> Column:
        left, right = F.regexp_extract(a, "([A-Za-z]{2,})-$", 1), F.regexp_extract(x, "^([a-z][A-Za-z]*)", 1)
        glued = F.when(F.array_contains(known, F.lower(F.concat(left, F.lit("-"), right))), F.concat(a, x)).otherwise(F.concat(F.regexp_replace(a, "-$", ""), x))
        return F.when(a == "", x).when((left != "") & (right != ""), glued).otherwise(F.concat(a, F.lit(" "), x))

    parts = F.filter(F.transform(lines, strip), lambda x: x != "")
    return normal(F.aggregate(parts, F.lit(""), add))


def split_bullets(x: Column) -> Column:
    """The introduction and the bullets of a text with two bullets or more, as two texts; else the text alone."""
    head, rest = strip(F.substring_index(x, "•", 1)), strip(F.regexp_extract(x, "(?s)^[^•]*•(.*)$", 1))
    two = (F.length(x) - F.length(F.replace(x, F.lit("•"), F.lit(""))) >= 2) & (head != "")
    return F.when(two, F.array(head, F.concat(F.lit("• "), rest))).otherwise(F.array(x))


def list_items(x: Column, longest: int = 42) -> Column:
    """intro and items (label, text) of a text with bullets; a label ends at the first colon of the item's first characters."""
    parts = F.split(x, "•")
    items = F.filter(F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), strip), lambda t: t != "")
    label = lambda t: F.nullif(F.regexp_extract(t, f"^([^:：]{{1,{longest}}})[:：]", 1), F.lit(""))
    item = lambda t: F.struct(label(t).alias("label"), F.when(label(t).isNull(), t).otherwise(strip(F.substring(t, F.length(label(t)) + 2, F.length(t)))).alias("text"))
    return F.struct(strip(F.get(parts, F.lit(0))).alias("intro"), F.transform(items, item).alias("items"))


def blank_line_paragraphs(x: Column) -> Column:
    """What stands between blank lines, stripped; nothing blank."""
    return F.filter(F.transform(F.split(x, r"\n[ \t\r]*\n\s*"), strip), lambda t: t != "")


def filled_table(rows: Column) -> Column:
    """Rows of cells without the rows and columns that are blank throughout; null unless two rows and two columns are left."""
    bare = F.transform(rows, lambda r: F.transform(r, lambda c: F.btrim(F.coalesce(c, F.lit("")), F.lit(BLANKS))))
    width = lambda kept: F.coalesce(F.array_max(F.transform(kept, F.size)), F.lit(0))
    filled = lambda r, k: F.coalesce(F.get(r, k), F.lit("")) != ""
    columns = lambda kept: F.filter(F.sequence(F.lit(0), F.greatest(width(kept) - 1, F.lit(0))), lambda k: F.exists(kept, lambda r: filled(r, k)))
    table = lambda kept, ks: F.when((F.size(kept) >= 2) & (F.size(ks) >= 2), F.transform(kept, lambda r: F.transform(ks, lambda k: F.coalesce(F.get(r, k), F.lit("")))))
    return let(F.filter(bare, lambda r: F.exists(r, lambda c: c != "")), lambda kept: let(columns(kept), lambda ks: table(kept, ks)))


def markdown_table(rows: Column) -> Column:
    """filled_table as Markdown, the first row as its head; null where that is null."""
    cell = lambda c: F.replace(F.when(c.contains("\n"), F.regexp_replace(c, r"\s*\n\s*", " ")).otherwise(c), F.lit("|"), F.lit("\\|"))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, cell), " | "), F.lit(" |"))
    rule = lambda r: F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.size(r)))
    whole = lambda table: F.array_join(F.flatten(F.transform(table, lambda r, k: F.when(k == 0, F.array(line(r), rule(r))).otherwise(F.array(line(r))))), "\n")
    return let(filled_table(rows), whole)


def tab_separated(rows: Column) -> Column:
    return F.array_join(F.transform(rows, lambda r: F.array_join(F.transform(r, lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"[\t\n]+", " ")), "\t")), "\n")


def source_type(name: Column, content: Column) -> Column:
    """pdf by the name's suffix or the content's first bytes, else other."""
    return F.when(F.lower(name).endswith(".pdf") | content.startswith("%PDF"), "pdf").otherwise("other")
