"""Column expressions with Python string semantics, built from Spark SQL functions.

Everything here returns a ``Column`` and stays inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's ``str.isspace()`` accepts (and so ``str.strip()``
# removes), in code-point order: tab, line feed, vertical tab, form feed, carriage return,
# the four information separators 0x1c-0x1f, space, next line 0x85, no-break space 0xa0,
# ogham space 0x1680, the spaces 0x2000-0x200a, line separator 0x2028, paragraph separator
# 0x2029, narrow no-break space 0x202f, medium mathematical space 0x205f, ideographic
# space 0x3000. Written as one regex class that both Java regex and RE2 (the oracle) read
# the same way.
PY_SPACE_CLASS = (
    r"[\t\n\x0b\f\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
PY_STRIP_PATTERN = f"^{PY_SPACE_CLASS}+|{PY_SPACE_CLASS}+$"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def py_str(col, null_text: str = "nan") -> Column:
    """``str(x)`` of a pandas cell: a missing value prints as ``nan``."""
    return F.coalesce(_c(col).cast("string"), F.lit(null_text))


def py_strip(col) -> Column:
    """``str.strip()``: remove every Unicode blank at both ends (``trim`` removes only spaces).

    The pattern runs over texts only that begin or end with a blank.
    """
    c = _c(col)
    ends = F.concat(F.substr(c, F.lit(1), F.lit(1)), F.substr(c, F.lit(-1), F.lit(1)))
    return F.when(ends.rlike(PY_SPACE_CLASS), F.regexp_replace(c, PY_STRIP_PATTERN, "")).otherwise(c)


def py_capitalize(col) -> Column:
    """``str.capitalize()``: first character upper case, the rest lower case (not ``initcap``)."""
    c = _c(col)
    return F.concat(F.upper(F.substr(c, F.lit(1), F.lit(1))), F.lower(F.substr(c, F.lit(2))))


def base_id(col) -> Column:
    """Text before the first ``_`` (the whole text when there is none)."""
    return F.substring_index(_c(col), "_", 1)


def padded_id(col, strict: bool = True) -> Column:
    """Zero-pad to at least three characters.

    ``strict=True`` parses the text as an integer first (``f"{int(x):03}"``); text that is not an
    integer gives null instead of failing the job. ``strict=False`` is ``str.zfill(3)``: pure text
    padding that keeps a leading sign in front.
    """
    c = _c(col)
    if strict:
        v = c.try_cast("bigint")
        return F.when(v.isNotNull(), F.format_string("%03d", v))
    signed = c.rlike("^[+-]")
    body = F.when(signed, F.substr(c, F.lit(2))).otherwise(c)
    width = F.when(signed, F.lit(2)).otherwise(F.lit(3))
    padded = F.lpad(body, F.greatest(width, F.length(body)), "0")
    return F.when(signed, F.concat(F.substr(c, F.lit(1), F.lit(1)), padded)).otherwise(padded)


def null_tokens(col, tokens) -> Column:
    """Turn any of ``tokens`` into null (the pandas reader's missing-value vocabulary)."""
    c = _c(col)
    return F.when(c.isin(list(tokens)), F.lit(None).cast("string")).otherwise(c)


def canonical_id(col, all_int) -> Column:
    """Id text as a type-inferring reader would return it.

    ``all_int`` is a boolean column/scalar telling whether the *whole* column parses as integers;
    then leading zeros are lost (``007`` -> ``7``). Otherwise the text is kept.
    """
    c = _c(col)
    return F.when(all_int, c.try_cast("bigint").cast("string")).otherwise(c)


def config_label(prefix: str, *parts) -> Column:
    """``f"{prefix}{a}_{b}..."`` from label columns: ``concat`` of alternating names and values."""
    items = [F.lit(prefix)]
    for i, (name, col) in enumerate(parts):
        items.append(F.lit(("_" if i else "") + f"{name}_"))
        items.append(_c(col).cast("string"))
    return F.concat(*items)
