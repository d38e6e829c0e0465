"""Ranked output: the reference's ``ORDER BY count DESC LIMIT n`` with deterministic ties."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def top_k(df: DataFrame, measure: str, keys: list[str], n: int | None) -> DataFrame:
    """Order by ``measure`` descending, then the keys ascending (NULLs first), keep ``n``.

    ``orderBy(...).limit(n)`` plans as TakeOrderedAndProject: each task keeps its own top ``n``
    and only those reach the final merge. ``n=None`` orders without a limit.
    """
    ordered = df.orderBy(F.desc(measure), *[F.asc_nulls_first(k) for k in keys])
    return ordered if n is None else ordered.limit(n)


def parse_limit(value, default: int = 50) -> int | None:
    """Q35: the visitors report's ``parseInt(limit) || 50``; negative means no limit.

    JavaScript's parseInt reads an optional sign and leading digits after optional whitespace
    (a ``0x`` prefix switches to hex); no digits, or 0, falls back to the default. SQLite's
    ``LIMIT`` with a negative value returns every row, shown here as ``None``.
    """
    import re

    if value is None:
        return default
    if isinstance(value, (list, tuple)):
        value = ",".join(str(v) for v in value)
    if isinstance(value, bool):
        value = str(value).lower()
    if isinstance(value, (int, float)):
        value = repr(value) if isinstance(value, float) else str(value)
    m = re.match(r"\s*([+-]?)(0[xX][0-9a-fA-F]+|\d+)", str(value))
    if not m:
        return default
    digits = m.group(2)
    n = int(digits, 16) if digits[:2].lower() == "0x" else int(digits)
    if m.group(1) == "-":
        n = -n
    if n == 0:
        return default
    return None if n < 0 else n
