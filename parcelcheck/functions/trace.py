"""GPS trace text to polygon.

A trace is ``lat lon altitude accuracy`` per vertex, vertices joined by ``;``.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from parcelcheck.functions.rings import close_ring, empty_geom, let, polygon, vertex
from parcelcheck.params import GPS_ACCURACY_M, TRACE_CELL_LIMIT

ZERO_ACCURACY = 1e-9


def parse_trace(
    text: Column, accuracy_m: float = GPS_ACCURACY_M, accuracy_zero_valid: bool = True
) -> Column:
    """Struct of the kept vertices and the number of skipped ones.

    Blank vertices and those measured worse than ``accuracy_m`` are skipped;
    with ``accuracy_zero_valid=False`` so are those of accuracy zero.
    """

    def read(token: Column) -> Column:
        return let(
            F.split(F.trim(token), " "),
            lambda p: F.struct(
                F.get(p, F.lit(0)).try_cast("double").alias("y"),
                F.get(p, F.lit(1)).try_cast("double").alias("x"),
                F.get(p, F.lit(3)).try_cast("double").alias("acc"),
            ),
        )

    def usable(v: Column) -> Column:
        ok = v["x"].isNotNull() & v["y"].isNotNull() & (v["acc"] <= accuracy_m)
        if not accuracy_zero_valid:
            ok = ok & (F.abs(v["acc"]) >= ZERO_ACCURACY)
        return F.coalesce(ok, F.lit(False))

    def summary(tokens: Column) -> Column:
        return let(
            F.filter(F.transform(tokens, read), usable),
            lambda kept: F.struct(
                F.transform(kept, lambda v: vertex(v["x"], v["y"])).alias("kept"),
                (F.size(tokens) - F.size(kept)).alias("skipped"),
            ),
        )

    return F.when(text.isNotNull(), let(F.split(text, ";"), summary))


@cache
def named_trace_polygon(
    column: str,
    accuracy_m: float = GPS_ACCURACY_M,
    accuracy_zero_valid: bool = True,
    cell_limit: int | None = None,
) -> Column:
    """:func:`trace_polygon` of a named column, built once per process."""
    return trace_polygon(F.col(column), accuracy_m, accuracy_zero_valid, cell_limit)


def cut_at_limit(text: Column, cell_limit: int = TRACE_CELL_LIMIT) -> Column:
    """True if a spreadsheet cell of this limit may have cut the text."""
    return F.coalesce(F.length(text) == cell_limit, F.lit(False))


def trace_polygon(
    text: Column,
    accuracy_m: float = GPS_ACCURACY_M,
    accuracy_zero_valid: bool = True,
    cell_limit: int | None = None,
) -> Column:
    """Polygon of a trace; unusable traces give the empty polygon.

    Unusable: no text, fewer than three vertices, fewer than four kept per
    skipped one, and, only where ``cell_limit`` is given because the text comes
    from a spreadsheet, a text of exactly that length. Such rows can be told
    by :func:`cut_at_limit`.
    """

    def build(t: Column) -> Column:
        n = F.size(t["kept"])
        return F.when((n < 3) | (n < 4 * t["skipped"]), empty_geom()).otherwise(
            polygon(close_ring(t["kept"]))
        )

    unusable = text.isNull()
    if cell_limit is not None:
        unusable = unusable | cut_at_limit(text, cell_limit)
    return F.when(unusable, empty_geom()).otherwise(
        let(parse_trace(text, accuracy_m, accuracy_zero_valid), build)
    )
