"""Text forms of numbers and codes. Arguments are column names or SQL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def whole_sql(amount: str) -> str:
    """Whole number with thousands separators, halves rounded away from zero.

    Any size is written out; no padding and no overflow marks.
    """
    return f"format_number(round({amount}, 0), 0)"


def whole_money(amount: str) -> Column:
    return F.expr(f"concat('$', {whole_sql(amount)})")


def signed_money(change: str) -> Column:
    """``+$1,530`` or ``$-1,530``; a dash when nothing changed."""
    return F.expr(
        f"CASE WHEN {change} = 0 THEN '—' "
        f"ELSE concat(CASE WHEN {change} > 0 THEN '+' ELSE '' END, '$', {whole_sql(change)}) END"
    )


def signed_percent(change: str, percent: str) -> Column:
    return F.expr(
        f"CASE WHEN {change} = 0 THEN '—' "
        f"ELSE concat(CASE WHEN {change} > 0 THEN '+' ELSE '' END, string({percent}), '%') END"
    )


def title_case(code: Column) -> Column:
    return F.initcap(F.translate(code, "_-", "  "))


def shorten(text: Column, length: int) -> Column:
    return F.substring(text, 1, length)
