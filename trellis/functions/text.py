"""Text scalars as Column expressions (line counts, pre-tokens, templates, display rules)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LINE_BREAK_REGEX = r"\r\n|\r|\n"
# Word / number / symbol-run pre-tokenizer used for the default token count.
PRE_TOKEN_REGEX = r"\p{L}+|\p{N}{1,3}|[^\s\p{L}\p{N}]+"
# Repository URL rule and repository-name rule of the import form.
GITHUB_URL_REGEX = r"^https://github\.com/[\w.-]+/[\w.-]+(\.git)?$"
REPO_NAME_REGEX = r"github\.com/[\w.-]+/([\w.-]+)(\.git)?"
TRUNCATE_AT = 100
TRUNCATE_SUFFIX = "... "
# Whitespace removed by the UI's trim: tab, LF, VT, FF, CR, BOM and Unicode separators.
UI_TRIM_REGEX = r"^[\t\n\x0B\f\r\x{FEFF}\p{Z}]+|[\t\n\x0B\f\r\x{FEFF}\p{Z}]+$"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _count_literal(t: Column, lit: str) -> Column:
    """Occurrences of a one-byte literal: byte-length difference after removing it (no regex)."""
    return F.octet_length(t) - F.octet_length(F.replace(t, F.lit(lit), F.lit("")))


def raw_line_count(text) -> Column:
    """Lines as a line reader sees them: ``\\r\\n``, ``\\r`` and ``\\n`` end a line,
    a trailing break adds no line, the empty text has 0 lines.

    Breaks are counted as ``#\\n + #\\r − #\\r\\n`` with literal replaces (each a
    single byte in UTF-8), which equals a regex count of ``\\r\\n|\\r|\\n``.
    """
    t = _c(text)
    crlf = (F.octet_length(t) - F.octet_length(F.replace(t, F.lit("\r\n"), F.lit("")))) / 2
    breaks = _count_literal(t, "\n") + _count_literal(t, "\r") - crlf.cast("bigint")
    ends_with_break = F.substring(t, -1, 1).isin("\n", "\r")
    return (F.when(t.isNull(), F.lit(None).cast("bigint"))
            .when(F.length(t) == 0, F.lit(0).cast("bigint"))
            .otherwise((breaks + F.when(ends_with_break, 0).otherwise(1)).cast("bigint")))


def pre_token_count(text) -> Column:
    """Number of pre-tokens (letter runs, 1-3 digit groups, symbol runs).

    The three token classes cover every non-whitespace character, so replacing
    each token by ``x`` leaves one ``x`` per token plus the original
    whitespace; counting the ``x`` bytes gives the match count without
    materialising an array of matches.
    """
    t = _c(text)
    marked = F.regexp_replace(t, PRE_TOKEN_REGEX, "x")
    return F.coalesce(_count_literal(marked, "x").cast("bigint"), F.lit(0).cast("bigint"))


def fill_template(template, pairs) -> Column:
    """Sequential placeholder replacement, in the given order.

    Text inserted by an earlier pair is itself subject to the later pairs,
    exactly like chaining ``str.replace``. ``pairs`` is a list of
    ``(placeholder, Column)``; NULL values insert ''.
    """
    out = _c(template) if not isinstance(template, str) else F.lit(template)
    for key, value in pairs:
        out = F.replace(out, F.lit(key), F.coalesce(_c(value), F.lit("")))
    return out


def ui_trim(text) -> Column:
    """Trim as the UI does (all Unicode whitespace and line terminators, both ends)."""
    return F.regexp_replace(_c(text), UI_TRIM_REGEX, "")


def truncate_text(text) -> Column:
    """First 100 chars, trimmed, plus ``'... '``; shorter text unchanged; NULL → ''."""
    t = _c(text)
    return (F.when(t.isNull(), F.lit(""))
            .when(F.length(t) <= TRUNCATE_AT, t)
            .otherwise(F.concat(ui_trim(F.substring(t, 1, TRUNCATE_AT)), F.lit(TRUNCATE_SUFFIX))))


def format_count(x) -> Column:
    """Number with thousands separators and up to three decimals; NULL and non-numeric types show as ``0``."""
    c = _c(x)
    digits = F.regexp_replace(F.format_number(F.round(c.try_cast("double"), 3), 3), r"\.?0+$", "")
    return F.when(c.isNull() | ~F.typeof(c).rlike("^(tinyint|smallint|int|bigint|float|double|decimal.*)$"), F.lit("0")).otherwise(digits)


def is_valid_repo_url(url) -> Column:
    return F.coalesce(_c(url).rlike(GITHUB_URL_REGEX), F.lit(False))


def repo_name(url) -> Column:
    return F.regexp_extract(_c(url), REPO_NAME_REGEX, 1)


def non_empty(text) -> Column:
    return F.coalesce(_c(text), F.lit("")) != ""


def safe_int(x) -> Column:
    """Numeric conversion where an error or NULL becomes 0."""
    return F.coalesce(_c(x).try_cast("int"), F.lit(0))


def zero_is_missing(a, b) -> Column:
    """``a || b`` of JavaScript for numbers: 0 and NULL fall back to ``b``."""
    return F.coalesce(F.nullif(_c(a), F.lit(0)), _c(b))
