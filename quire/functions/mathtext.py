"""Scalars over text with formulas: parity, balance, repairs, placeholders, density."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = "⟦?⟧"
#: Unicode ranges that count as mathematics; = and + do too.
MATH_RANGES = (
    (0x00AC, 0x00AC), (0x00B0, 0x00BE), (0x00D7, 0x00D7), (0x00F7, 0x00F7), (0x0370, 0x03FF), (0x2032, 0x2037), (0x2044, 0x2044),
    (0x2061, 0x2064), (0x2070, 0x209F), (0x2100, 0x214F), (0x2150, 0x218F), (0x2190, 0x21FF), (0x2200, 0x22FF), (0x2300, 0x23FF),
    (0x25A0, 0x25FF), (0x2600, 0x26FF), (0x27C0, 0x27EF), (0x27F0, 0x27FF), (0x2900, 0x297F), (0x2980, 0x29FF), (0x2A00, 0x2AFF),
    (0x2B00, 0x2BFF), (0x3008, 0x3011), (0x1D400, 0x1D7FF), (0x1EE00, 0x1EEFF),
)
MATH_CLASS = "[=+" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in MATH_RANGES) + "]"
UNRENDERABLE = r"[\x{FFFD}\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}\x{E000}-\x{F8FF}]"
#: Commands that need an argument.
NEED = ("sqrt", "frac", "vec", "hat", "bar", "overline", "underline", "widehat", "widetilde", "text", "textrm", "textbf", "mathrm", "mathbb", "mathcal", "binom", "stackrel", "boxed", "operatorname", "pmod", "pod")
_NEED = "|".join(NEED)
#: Environments of cells.
ENVIRONMENTS = ("matrix", "bmatrix", "pmatrix", "vmatrix", "Vmatrix", "smallmatrix", "array", "cases", "aligned")
#: Fixed value: what makes a dollar one of money: an amount after it that no letter, script, brace or command follows.
CURRENCY = r"(?<!\\)\$(?=[0-9][0-9,]*(?:\.[0-9]+)?(?![0-9A-Za-z^{_\\]))"


def count(x: Column, pattern: str) -> Column:
    return F.regexp_count(x, F.lit(pattern)).cast("long")


def mark_unrenderable(x: Column) -> Column:
    return F.regexp_replace(x, UNRENDERABLE, MISSING)


def missing_glyphs(x: Column) -> Column:
    return ((F.length(x) - F.length(F.replace(x, F.lit(MISSING), F.lit("")))) / len(MISSING)).cast("long")


def math_chars(x: Column) -> Column:
    """Of ASCII alone only = and + count, without a search through the ranges for each character."""
    signs = (F.length(x) - F.length(F.translate(x, "=+", ""))).cast("long")
    return F.when(F.octet_length(x) == F.length(x), signs).otherwise(count(x, MATH_CLASS))


def math_ratio(x: Column) -> Column:
    return F.coalesce(math_chars(x) / F.nullif(F.length(F.regexp_replace(x, r"[ \t\n\x0B\f\r\x{00A0}]", "")), F.lit(0)), F.lit(0.0))


def math_coverage(x: Column) -> Column:
    """Share of the characters that stand inside dollars."""
    size = lambda t: F.length(F.regexp_replace(t, r"[ \t\n\x0B\f\r\x{00A0}$]", ""))
    inside = F.aggregate(F.regexp_extract_all(x, F.lit(r"(?s)\$\$.+?\$\$|\$.+?\$"), F.lit(0)), F.lit(0), lambda a, m: a + size(m))
    return F.least(F.lit(1.0), F.coalesce(inside / F.nullif(size(x), F.lit(0)), F.lit(0.0)))


def unescaped_dollars(x: Column) -> Column:
    return count(x, r"(?<!\\)\$")


def balance_dollars(x: Column) -> Column:
    """With an odd number of dollars the first that stands before an amount is escaped; one does, as it makes them even."""
    return F.when(unescaped_dollars(x) % 2 == 1, F.regexp_replace(x, "(?s)^(.*?)" + CURRENCY, r"$1\\\$")).otherwise(x)


def bare_commands(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(rf"\\({_NEED})(?![a-zA-Z])(?![\[{{])"), F.lit(1))


def repair_bare_commands(x: Column) -> Column:
    """Commands without an argument take the token after the formula's end, or an empty one; \\frac takes two."""
    x = F.regexp_replace(x, rf"\\({_NEED})[ \t]*\$[ \t]*([A-Za-z0-9](?:[_^]\{{[^}}]*\}})?|\\[A-Za-z]+)", r"\\$1{$2}\$")
    x = F.regexp_replace(x, rf"\\({_NEED})[ \t]*\$[ \t]*\{{([^{{}}]*)\}}", r"\\$1{$2}\$")
    x = F.regexp_replace(x, r"\\frac\{([^{}]*)\}(?!\s*\{)", r"\\frac{$1}{\\ }")
    return F.regexp_replace(x, rf"\\({_NEED})(?![a-zA-Z])(?![\[{{])", r"\\$1{\\ }")


def escape_math_angles(x: Column) -> Column:
    """< and > inside dollars become commands; what stands outside stays."""
    def fix(m: Column) -> Column:
        for a, b in (("&lt;", r"\lt{}"), ("&gt;", r"\gt{}"), ("<", r"\lt{}"), (">", r"\gt{}")):
            m = F.replace(m, F.lit(a), F.lit(b))
        return m

    spans = F.regexp_extract_all(x, F.lit(r"\$[^$\n]{0,300}\$"), F.lit(0))
    between = F.split(x, r"\$[^$\n]{0,300}\$")
    return F.array_join(F.flatten(F.transform(between, lambda b, i: F.array_compact(F.array(b, fix(F.get(spans, i)))))), "")


def plain_escape(x: Column) -> Column:
    """What Markdown or a formula renderer would take for its own is escaped; letters, digits and simple marks alone stay as they are."""
    y = mark_unrenderable(F.replace(x, F.lit("\\"), F.lit("∕")))
    y = F.regexp_replace(y, r"([*_`$])", r"\\$1")
    y = F.regexp_replace(y, r"(^|[\n ])([#>])", r"$1\\$2")
    y = F.replace(F.replace(y, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    return F.when(x.rlike(r"^[A-Za-z0-9 .,;:!?()'-]*\z"), x).otherwise(y)


#: A slash before a relation's command, and the command of both.
SLASHED = ((r"/\s*\\in\b", r"\\notin"), (r"/\s*\\subset\b", r"\\not\\subset"), (r"/\s*\\equiv\b", r"\\not\\equiv"), (r"/\s*=", r"\\neq "), (r"[ \t]{2,}", " "))


def slash_commands(x: Column) -> Column:
    """Of a formula whose characters are commands: a relation struck out by a slash becomes one command. Without slashes or blanks that meet nothing changes."""
    some = x.contains("/") | x.contains("  ") | x.contains("\t")
    return F.when(some, reduce(lambda c, p: F.regexp_replace(c, *p), SLASHED, x)).otherwise(x)


def display_equation(x: Column) -> Column:
    """Up to 500 characters, and mostly formula or one formula with its number in brackets before or after it."""
    t = F.regexp_replace(x, r"^\s+|\s+$", "")
    numbered = t.rlike(r"^\([0-9]+[a-z]?\)\s*\$[^$]+\$$|^\$[^$]+\$\s*\([0-9]+[a-z]?\)$")
    return F.length(t).between(1, 500) & ((math_coverage(x) >= 0.6) | numbered)


def repaired(x: Column) -> Column:
    """Commands without arguments get them, then angles in formulas become commands."""
    return escape_math_angles(repair_bare_commands(x))


def unrepaired(x: Column, had_placeholder: Column) -> Column:
    """Names of what shows that a placeholder was left or covered up."""
    # fixed values: patterns of empty pairs and environments
    inside = F.exists(F.regexp_extract_all(x, F.lit(r"(?s)\$\$.+?\$\$|\$.+?\$"), F.lit(0)), lambda m: m.contains("?"))
    beside = x.rlike(r"\\[A-Za-z]{2,}\s*\?|\?\s*\\[A-Za-z]{2,}")
    gap = r"(?:\s|~|\\[ ,;:!>]|\\q?quad)*"
    pair = x.rlike(rf"\\left\s*[()\[\]{{}}|/]{gap}\\right\s*[()\[\]{{}}|/]|\\langle\s*\\rangle|\\lceil\s*\\rceil|\\lfloor\s*\\rfloor")
    bare = rf"(?:{gap}|&|\\\\|\\hspace\*?\{{[^}}]*\}})*"
    closed = "|".join(rf"\\begin\{{{name}\}}{r'\s*(?:\{[^}]*\})?' if name == 'array' else ''}{bare}\\end\{{{name}\}}" for name in ENVIRONMENTS)
    empty = x.rlike(closed)
    return F.array_compact(F.array(F.when(x.contains(MISSING), F.lit("placeholder")), F.when(had_placeholder & (inside | beside), F.lit("question mark")), F.when(had_placeholder & pair, F.lit("empty delimiters")), F.when(had_placeholder & empty, F.lit("empty environment"))))
