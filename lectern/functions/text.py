"""Text columns: trimming, canonical form, display and lookup forms."""
from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from lectern import values as v
from lectern.functions import kernels
from lectern.functions.arrays import let

WS = v.WS_CLASS


def trim_ws(text: Column) -> Column:
    """Trim the explicit white-space class (``trim`` strips plain spaces only)."""
    return F.btrim(text, F.lit(v.WS_CHARS))


def is_blank(text: Column) -> Column:
    return ~text.rlike(f"[^{WS}]")


def collapse_ws(text: Column) -> Column:
    return trim_ws(F.regexp_replace(text, f"[{WS}]{{2,}}|[{WS}&&[^ ]]", " "))  # a single space stays without being rewritten


def normalise_text(text: Column) -> Column:
    """Line ends to LF, control characters to spaces, space runs to one, blank-line runs to one, trimmed."""
    out = F.regexp_replace(text, r"\r\n?", "\n")
    out = F.regexp_replace(out, r"[\x{00}-\x{08}\x{0b}-\x{1f}\x{7f}]", " ")
    out = F.regexp_replace(out, r"[ \t]{2,}|\t", " ")
    return trim_ws(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def dehyphenate(text: Column) -> Column:
    """Rejoin a word split by a line-break hyphen: ``meth- od`` -> ``method``."""
    return F.regexp_replace(text, r"(\p{L})[-\x{ad}\x{2010}] (\p{Ll})", "$1$2")


def display_quote(text: Column) -> Column:
    return dehyphenate(collapse_ws(text))


def short_query(quote: Column) -> Column:
    """Opening words of a quote for a find bar: at most 60 characters, cut at a space beyond position 20."""
    clean = display_quote(quote)
    cut = F.substring(clean, 1, 60)
    space = F.length(cut) - F.length(F.substring_index(cut, " ", -1)) - 1
    return (
        F.when(F.length(clean) <= 60, clean)
        .when(space > 20, F.substring(cut, F.lit(1), space))
        .otherwise(cut)
    )


def location_page(location: Column) -> Column:
    """1-based page named by a location text, 0 when none is acceptable."""
    def guarded(pattern: str) -> Column:
        # Java's \b looks at Unicode letters; the contract is ASCII.
        regex = pattern.format(ws=WS).replace(r"\b", "(?<![A-Za-z0-9_])")
        found = F.regexp_extract(location, regex, 1)
        page = F.when(found != "", found.cast("int"))
        return F.when(page.between(1, v.MAX_PAGE_NUMBER), page)

    return F.coalesce(*[guarded(p) for p in v.LOCATION_PATTERNS], F.lit(0))


def html_escape(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(mark), F.lit(entity))
    return out


def strict_json(text: Column) -> Column:
    """A JSON text as a variant, null where it is none or where anything but blanks follows its value.

    The built-in parser stops after the first value. Here the text is the first element of a list that a hash of it closes,
    so the list can be read to that hash only if the text is one whole value.
    """
    seal = F.md5(text)

    def first(sealed: Column) -> Column:
        return F.when(F.try_variant_get(sealed, "$[1]", "string") == seal, F.try_variant_get(sealed, "$[0]", "variant"))

    return let(F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"'), seal, F.lit('"]'))), first)


def zero_pad(number: Column, width: int) -> Column:
    """Left zero padding that also cuts to ``width``."""
    return F.lpad(number.cast("string"), width, "0")


def models_url(endpoint: Column) -> Column:
    """Model-list endpoint that belongs to a chat endpoint, null when it cannot be told."""
    url = F.regexp_replace(trim_ws(endpoint), r"/+\z", "")
    tail = r"/chat/completions\z"
    return F.when(url.rlike(tail), F.regexp_replace(url, tail, "/models"))


# --- canonical form ------------------------------------------------------------------------------------------

# Code points whose canonical form the built-in functions reproduce: NFKC leaves them alone (or they are dropped)
# and lower-casing does not depend on neighbours. Sigma is left out because ``lower`` has a word-final rule.
PLAIN_CLASS = (
    r"\x{00}-\x{a7}\x{a9}\x{ab}-\x{ae}\x{b0}\x{b1}\x{b6}\x{b7}\x{bb}\x{bf}-\x{12f}\x{131}\x{134}-\x{13e}"
    r"\x{141}-\x{148}\x{14a}-\x{17e}\x{300}-\x{33f}\x{391}-\x{3a1}\x{3a4}-\x{3a9}\x{3b1}-\x{3c9}\x{400}-\x{481}"
    r"\x{48a}-\x{4ff}\x{1680}\x{2000}-\x{200a}\x{2010}-\x{2016}\x{2018}-\x{2023}\x{2028}\x{2029}\x{202f}\x{2032}"
    r"\x{205f}\x{2212}\x{3000}-\x{3002}\x{3008}-\x{3011}\x{3041}-\x{3096}\x{30a1}-\x{30fa}\x{4e00}-\x{9fff}"
    r"\x{ac00}-\x{d7a3}\x{feff}\x{a0}"
)


_DELETED = "".join(sorted(v.DROP_CHARS))


def canon_plain(text: Column) -> Column:
    """Canonical form for text made of ``PLAIN_CLASS`` only; one pass in the JVM."""
    straight = "'" * len(v.SINGLE_QUOTES) + '"' * len(v.DOUBLE_QUOTES)
    return F.lower(F.translate(text, v.SINGLE_QUOTES + v.DOUBLE_QUOTES + _DELETED, straight))


@F.pandas_udf(T.StringType())
def canon_udf(texts: pd.Series) -> pd.Series:
    return texts.map(kernels.canon_text, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def canon_array_udf(arrays: pd.Series) -> pd.Series:
    return arrays.map(lambda xs: [kernels.canon_text(x) for x in xs], na_action="ignore")


def needs_kernel(text: Column) -> Column:
    # the leading range lets ASCII letters fail after one test instead of after every range of the class
    return text.rlike(r"[\x{a8}-\x{10ffff}&&[^%s]]" % PLAIN_CLASS)


def canon(text: Column) -> Column:
    """Canonical form. Only texts with unusual characters travel to Python; the others pass as nulls."""
    return F.coalesce(canon_udf(F.when(needs_kernel(text), text)), canon_plain(text))


def canon_array(texts: Column) -> Column:
    """``canon`` for every element of an array of texts."""
    return F.coalesce(canon_array_udf(F.when(F.exists(texts, needs_kernel), texts)), F.transform(texts, canon_plain))
