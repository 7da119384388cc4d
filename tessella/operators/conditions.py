"""Equality conditions of single queries on rows of the corpus, as data: a query's map of names and values against a row's."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAP = "map<string,string>"


def attributes(df: DataFrame, names: list[str]) -> Column:
    """The map of a row's columns as texts; a null column is missing from it."""
    if not names:
        return F.lit(None).cast(MAP)
    return F.map_filter(F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.col(n).cast("string") for n in names])), lambda _, v: v.isNotNull())


def plain_columns(df: DataFrame, *but: str) -> list[str]:
    """The columns that conditions can be held against: those of single values, but for those named."""
    return [c for c, kind in df.dtypes if c not in but and not kind.startswith(("array", "map", "struct", "binary", "variant"))]


def of(*parts: Column) -> Column:
    """One map of conditions of several; null ones have none, and of a name that occurs twice the last one counts."""
    entries = F.flatten(F.array(*[F.map_entries(F.coalesce(p, F.create_map().cast(MAP))) for p in parts]))
    names = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    last = lambda n: F.element_at(F.filter(entries, lambda e: e["key"] == n), -1)["value"]
    return F.map_from_arrays(names, F.transform(names, last))


def single(name: str, value: Column) -> Column:
    """A condition, or none where the value is null."""
    return F.when(value.isNotNull(), F.create_map(F.lit(name), value.cast("string")))


class Matcher:
    """Which rows of a block meet which conditions; each condition is looked at once."""

    def __init__(self, rows: list[list[tuple[str, str]] | dict | None]):
        self.n, self.rows = len(rows), [dict(r or ()) for r in rows]
        self._names: dict[str, np.ndarray] = {}
        self._found: dict[tuple, np.ndarray] = {}

    def mask(self, wanted) -> np.ndarray | None:
        """A row for each row of the block, or None where all meet the conditions."""
        wanted = tuple(sorted(dict(wanted or ()).items()))
        if not wanted:
            return None
        if wanted not in self._found:
            out = np.ones(self.n, bool)
            for name, value in wanted:
                if name not in self._names:
                    self._names[name] = np.array([r.get(name) for r in self.rows], object)
                out &= self._names[name] == value
            self._found[wanted] = out
        return self._found[wanted]

    def masks(self, wanted: list) -> np.ndarray | None:
        """queries x rows, or None where no query has conditions."""
        found = [self.mask(w) for w in wanted]
        if all(m is None for m in found):
            return None
        return np.array([np.ones(self.n, bool) if m is None else m for m in found])
