"""Columns of forecasts by horizon: found by their names, and filled where a horizon is missing."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A name's horizon: the number after one of these, at its end.
_HORIZON = re.compile(r"(?:_h|t_plus_)(\d{1,3})$")
#: Parts of a name that make it the better one of two for the same horizon.
SCORES = {"scaled": 10, "pred_close": 5}


def horizon_columns(columns: Iterable[str], parts: tuple[str, ...] = ("pred", "close"), without: tuple[str, ...] = ()) -> dict[int, str]:
    """The best column of each horizon, in order: names (in any case) with all ``parts`` and none of ``without``; of equals the first.

    Where no name has a horizon, the best without one is horizon 1.
    """
    best: dict[int, tuple[int, str]] = {}
    bare: tuple[int, str] | None = None
    for name in columns:
        low = name.lower()
        if not all(p in low for p in parts) or any(p in low for p in without):
            continue
        score = sum(n for part, n in SCORES.items() if part in low)
        if found := _HORIZON.search(low):
            h = int(found[1])
            if h not in best or score > best[h][0]:
                best[h] = score, name
        elif bare is None or score > bare[0]:
            bare = score, name
    if not best and bare:
        return {1: bare[1]}
    return {h: best[h][1] for h in sorted(best)}


def source_horizon(wanted: int, have: Iterable[int]) -> int | None:
    """The horizon itself, the nearest lower one, or else the nearest upper one; none if there is none."""
    have = sorted(have)
    lower = [h for h in have if h <= wanted]
    return lower[-1] if lower else have[0] if have else None


def fill_horizons(df: DataFrame, wanted: Iterable[int], found: dict[int, str], name: str = "h{:02d}") -> tuple[DataFrame, dict[int, int | None]]:
    """Adds a double column for each wanted horizon, 0 if there is no forecast at all; and where each comes from."""
    sources = {h: source_horizon(h, found) for h in wanted}
    columns: dict[str, Column] = {name.format(h): F.lit(0.0) if s is None else F.col(found[s]).cast("double") for h, s in sources.items()}
    return df.withColumns(columns), sources
