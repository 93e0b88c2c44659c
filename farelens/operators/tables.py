"""Sorted, paged and searchable result tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def paged_table(report: DataFrame, order: Sequence[Column], page: int = 0, size: int = 10) -> DataFrame:
    """One page of a report, pages counted from 0; ``order`` should leave no ties."""
    if page < 0 or size < 1:
        raise ValueError("page must be at least 0 and size at least 1")
    return report.orderBy(*order).offset(page * size).limit(size)


def page_after(
    report: DataFrame, order: Sequence[tuple[str, bool]], last: Mapping | None = None, size: int = 10
) -> DataFrame:
    """The page that follows the row ``last``, or the first page.

    ``order`` lists columns with True for ascending; together they should leave no ties. Unlike an
    offset, which sorts and throws away all pages before, this filters on the key of the row where the page
    before ended: every page costs the same, and rows that come or go on earlier pages shift nothing.
    NULLs stand first in ascending columns and last in descending ones, as in :func:`paged_table`.
    """
    if size < 1:
        raise ValueError("size must be at least 1")
    if last is not None:
        beyond, same = F.lit(False), F.lit(True)
        for name, ascending in order:
            value, column = last[name], F.col(name)
            if value is None:
                further = column.isNotNull() if ascending else F.lit(False)
            else:
                further = column > F.lit(value) if ascending else (column < F.lit(value)) | column.isNull()
            beyond = beyond | (same & further)
            same = same & column.eqNullSafe(F.lit(value))
        report = report.where(beyond)
    return report.orderBy(*[F.asc(name) if up else F.desc(name) for name, up in order]).limit(size)


def volume_page_after(rollup: DataFrame, last: Mapping | None = None, size: int = 10) -> DataFrame:
    """The page of a volume roll-up, latest first, after the row ``last``."""
    return page_after(rollup, [("date", False)], last, size)


def flow_page_after(flows: DataFrame, last: Mapping | None = None, size: int = 15) -> DataFrame:
    """The page of borough flows, busiest first, after the row ``last``."""
    return page_after(flows, [("trip_count", False), ("pickup_borough", True), ("dropoff_borough", True)], last, size)


def volume_page(rollup: DataFrame, page: int = 0, size: int = 10) -> DataFrame:
    """A page of a volume roll-up, latest first."""
    return paged_table(rollup, [F.desc("date")], page, size)


def flow_page(flows: DataFrame, page: int = 0, size: int = 15) -> DataFrame:
    """A page of borough flows, busiest first."""
    order = [F.desc("trip_count"), F.asc("pickup_borough"), F.asc("dropoff_borough")]
    return paged_table(flows, order, page, size)


def alert_page(alerts: DataFrame, page: int = 0, size: int = 5) -> DataFrame:
    """A page of data-quality alerts, most severe first; ids follow that order."""
    return paged_table(alerts, [F.asc("id")], page, size)


def flow_search(flows: DataFrame, pickup: str = "", dropoff: str = "") -> DataFrame:
    """Flows whose borough names contain the given texts, ignoring case; empty text matches all."""
    for column, text in (("pickup_borough", pickup), ("dropoff_borough", dropoff)):
        if text:
            flows = flows.where(F.contains(F.lower(column), F.lower(F.lit(text))))
    return flows
