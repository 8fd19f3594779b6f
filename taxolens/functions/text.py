"""Text column expressions: HTML cleaning, whitespace, imputation, display.

All functions build native Spark expressions so they stay inside
whole-stage codegen; none of them calls Python per row.
"""

from __future__ import annotations

from collections.abc import Sequence
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode whitespace as Python's ``str.split()``/``re \s`` sees it: Java's
# (?U)\s plus the ASCII separators \x1c-\x1f which Java omits.
WS_PATTERN = r"(?U)[\s\x1c-\x1f]+"

# Markup that carries no text, replaced by one space, in this order. An element or comment that is never closed runs
# to the end of the text; a ">" inside a quoted attribute does not end its tag; a tag with a stray quote ends at ">".
_MARKUP_PATTERNS = [
    r"(?is)<!--.*?(?:-->|\z)",
    r"(?is)<script\b[^>]*>.*?(?:</script\s*>|\z)",
    r"(?is)<style\b[^>]*>.*?(?:</style\s*>|\z)",
    r"(?is)<template\b[^>]*>.*?(?:</template\s*>|\z)",
    r"""(?is)<[a-zA-Z/!?][^>"']*(?:(?:"[^"]*"|'[^']*')[^>"']*)*>""",
    r"(?is)<[a-zA-Z/!?][^>]*>",
]

# Named character references, from the standard library's table of HTML 5; those without a semicolon are also read as
# the beginning of a longer name. Names that are met most often are looked up first: a map is searched in order.
NAMED = dict(sorted(html5.items()))
OPEN_NAMES = sorted((n for n in NAMED if not n.endswith(";")), key=lambda n: (-len(n), n))
COMMON = ["amp;", "lt;", "gt;", "quot;", "nbsp;", "apos;"]
# References that the HTML standard reads as Windows-1252, as far as that has the character.
WINDOWS = {n: c for n in range(0x80, 0xA0) if (c := bytes([n]).decode("cp1252", "replace")) != "\ufffd"}
_REFERENCE = r"^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_ws(c) -> Column:
    """Split on Unicode whitespace and join with one space."""
    return F.trim(F.regexp_replace(_col(c), WS_PATTERN, " "))


def strip_ws(c) -> Column:
    """Unicode whitespace off both ends."""
    ws = WS_PATTERN.removeprefix("(?U)")
    return F.regexp_replace(_col(c), f"(?U)^{ws}|{ws}$", "")


def bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _numbered(name: Column) -> Column:
    """Text of a numeric reference ``#...``, by the rules of the HTML standard."""
    digits = F.rtrim(name, F.lit(";"))
    # longer numbers are out of range, whatever their digits
    code = (F.when(digits.rlike("^#[xX]0*[0-9a-fA-F]{1,6}$"), F.conv(F.ltrim(F.substring(digits, 3, 1 << 20), F.lit("0")), 16, 10))
            .when(digits.rlike("^#0*[0-9]{1,7}$"), F.ltrim(F.substring(digits, 2, 1 << 20), F.lit("0")))
            .when(digits.rlike("^#[xX]?0+$"), F.lit("0")).otherwise(F.lit("1114112")))

    def char(n: Column) -> Column:
        windows = F.create_map(*[F.lit(x) for pair in WINDOWS.items() for x in pair])
        plain = F.decode(F.unhex(F.lpad(F.hex(n.cast("long")), 8, "0")), "UTF-32")
        silent = (n.between(1, 8) | n.between(0xE, 0x1F) | n.between(0x7F, 0x9F) | (n == 0xB)
                  | n.between(0xFDD0, 0xFDEF) | (n % 0x10000 >= 0xFFFE))
        return (F.when((n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), F.lit("\ufffd"))
                .when(n == 0xD, F.lit("\r")).when(n.between(0x80, 0x9F), F.coalesce(F.try_element_at(windows, n), plain))
                .when(silent, F.lit("")).otherwise(plain))

    return bound(F.coalesce(code.try_cast("int"), F.lit(0)), char)


def decode_entities(c) -> Column:
    """Decode numeric and named character references as browsers do, each once.

    References may lack their semicolon: numbers always, names if HTML 4 had them, then also before further letters.
    """
    # one literal: thousands of them, in every text column, would keep the planner busy for longer than the rows take
    names = F.str_to_map(F.lit("\x01".join(f"{k}\x02{v}" for k, v in NAMED.items())), F.lit("\x01"), F.lit("\x02"))
    open_name = "^(" + "|".join(OPEN_NAMES) + ")"

    def named(name: Column) -> Column:
        found = F.when(name == COMMON[0], NAMED[COMMON[0]])
        for n in COMMON[1:]:
            found = found.when(name == n, NAMED[n])
        start = F.regexp_extract(name, open_name, 1)
        begun = bound(start, lambda s: F.when(s != "", F.concat(
            F.try_element_at(names, s), F.substring(name, F.length(s) + 1, F.length(name)))))
        return F.coalesce(found, F.try_element_at(names, name), begun)

    def decoded(part: Column) -> Column:
        def of_name(name: Column) -> Column:
            text = F.when(name.startswith("#"), _numbered(name)).when(name != "", named(name))
            return F.coalesce(F.concat(text, F.substring(part, F.length(name) + 1, F.length(part))),
                              F.concat(F.lit("&"), part))
        return bound(F.regexp_extract(part, _REFERENCE, 1), of_name)

    def in_text(text: Column) -> Column:
        parts = F.split(text, "&")
        tail = bound(parts, lambda p: F.concat(F.element_at(p, 1), F.array_join(
            F.transform(F.slice(p, F.lit(2), F.size(p) - 1), decoded), "")))
        return F.when(F.contains(text, F.lit("&")), tail).otherwise(text)

    return bound(_col(c), in_text)


def strip_markup(c) -> Column:
    out = _col(c)
    for pat in _MARKUP_PATTERNS:
        out = F.regexp_replace(out, pat, " ")
    return out


def clean_html(c) -> Column:
    """Tags → space, entities decoded, whitespace collapsed; NULL → ''."""
    cleaned = normalize_ws(decode_entities(strip_markup(_col(c))))
    return F.coalesce(cleaned, F.lit(""))


def impute_text(cols: Sequence[str], present: Sequence[str] | None = None) -> Column:
    """First column whose trimmed text is longer than 2 chars, else ''.

    Columns not in ``present`` read as '' (the reference skips absent ones).
    """
    present = set(cols if present is None else present)
    picks = [F.when(F.length(strip_ws(F.col(c))) > 2, strip_ws(F.col(c)))
             for c in cols if c in present]
    return F.coalesce(*picks, F.lit("")) if picks else F.lit("")


def truncate_sample(c, n: int = 200) -> Column:
    """First ``n`` code points, 'N/A' when missing."""
    return F.coalesce(F.substring(_col(c), 1, n), F.lit("N/A"))


def display_name(c, max_len: int = 25, keep: int = 22) -> Column:
    """Names longer than 25 chars become 22 chars + '...'."""
    col = _col(c)
    return F.when(F.length(col) > max_len,
                  F.concat(F.substring(col, 1, keep), F.lit("..."))).otherwise(col)


def quality_band(purity) -> Column:
    """Purity > 0.9 high, > 0.8 medium, else low (strict)."""
    p = _col(purity)
    return (F.when(p > 0.9, F.lit("high"))
            .when(p > 0.8, F.lit("medium"))
            .otherwise(F.lit("low")))


def pct1(part, total) -> Column:
    """P10: percentage with one decimal, half-even like Python's round."""
    return F.bround(_col(part) * 100.0 / _col(total), 1)


def cluster_node_name(c) -> Column:
    """``Cluster {id}``."""
    return F.concat(F.lit("Cluster "), _col(c).cast("string"))


def cluster_id_from_name(c) -> Column:
    """Inverse of P11: drop every 'Cluster ' and trim."""
    return F.trim(F.replace(_col(c), F.lit("Cluster "), F.lit("")))


def split_key(cluster, label) -> Column:
    """Composite ``{cluster}__{label}`` key."""
    return F.concat_ws("__", _col(cluster).cast("string"), _col(label))
