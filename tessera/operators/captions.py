"""Caption construction (PR-4, PR-8) from metadata columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import py_capitalize, py_str, py_strip


def caption_expr(noun: str = "item", description: str = "description",
                 classification: str = "classification", primary: str = "primary_type",
                 secondary: str = "secondary_type") -> Column:
    """``"<description> This <noun> is classified as a <class>. It is of <Type> type"``,
    plus ``" and <Type2> type"`` when the second type is present and not empty.

    Missing description / class print as ``nan`` and a missing first type as ``Nan``, as
    ``str()`` of a missing pandas cell would. ``concat`` is null-strict, so the optional clause
    is an explicit ``when``.
    """
    return F.concat(
        py_strip(py_str(description)), F.lit(f" This {noun} is classified as a "),
        py_strip(py_str(classification)), F.lit(". "), type_suffix(primary, secondary))


def type_suffix(primary: str = "primary_type", secondary: str = "secondary_type") -> Column:
    """The end of a caption that names its types: ``"It is of <Type> type[ and <Type2> type]"``."""
    sec = F.col(secondary)
    clause = F.when(sec.isNotNull() & (F.length(sec) > 0),
                    F.concat(F.lit(" and "), py_capitalize(sec), F.lit(" type"))).otherwise(F.lit(""))
    return F.concat(F.lit("It is of "), py_capitalize(py_str(primary)), F.lit(" type"), clause)
