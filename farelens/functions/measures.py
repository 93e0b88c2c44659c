"""Means that can be merged: each is carried as parts, which are added up, and finished at the end.

Reports aggregate the fact table once on its own key, join the small result to a dimension and
aggregate again. A plain ``avg`` cannot be merged that way. The parts of a mean are the count of non-null
inputs and either a plain sum or, in the ``stable`` form, an exact one:

- A double is cut into pieces of fixed weight, each a whole number of at most 2**24 in size, and pieces of one
  weight are summed as longs. Sums of whole numbers do not depend on the order in which tasks finish, and
  there is room for 2**39 rows in a group.
- Pieces reach from 2**42 down to 2**-82, so every double between 1e-9 and 4e12 in size is kept whole; of
  smaller ones what lies below 2**-82 is rounded off.
- NaN, infinities and doubles from 2**42 on are added up apart as doubles: they lead to the NaN or infinity
  that a plain sum gives. Only a sum of several finite doubles from 2**42 on may depend on their order.
- The finished sum is the double nearest to the exact one, worked out once a group with decimals.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH = 25  # bits between the weights of neighbouring pieces
WEIGHTS = (18, -7, -32, -57, -82)  # powers of two, largest first
LARGEST = 2.0**42
PIECES = tuple(f"s{k}" for k in range(len(WEIGHTS)))
PART = "__"


def _column(name: str, part: str) -> str:
    return f"`{name}{PART}{part}`"


def mean_parts(names: Iterable[str], stable: bool = False) -> list[Column]:
    """Aggregates ``<name>__n`` and the parts of the sum for every named column of doubles.

    ``stable=True`` sums exactly, so that the last digit of a mean does not depend on task order. (Written as SQL
    text: a Column takes a call for every operator.)
    """
    out = []
    for name in names:
        value = f"`{name}`"
        parts = _exact_parts(value) if stable else {"sum": value}
        out += [F.expr(f"sum({part}) AS {_column(name, key)}") for key, part in parts.items()]
        out.append(F.expr(f"count({value}) AS {_column(name, 'n')}"))
    return out


def _exact_parts(value: str) -> dict[str, str]:
    """What is added up for the exact sum; NULL where a value has no such part."""
    inside = f"CASE WHEN abs({value}) < {LARGEST!r}D THEN {value} END"
    rounded = [f"rint({inside} * {2.0**-weight!r}D)" for weight in WEIGHTS]
    # Each piece is what the rounding to the next larger weight has left; both steps are exact.
    above = ["0D", *[f"{r} * {2.0**WIDTH!r}D" for r in rounded]]
    pieces = {key: f"cast({r} - {a} AS bigint)" for key, r, a in zip(PIECES, rounded, above)}
    return {**pieces, "wild": f"CASE WHEN NOT abs({value}) < {LARGEST!r}D THEN {value} END"}


def is_part(column: str) -> bool:
    return PART in column and column.rsplit(PART, 1)[1] in {*PIECES, "wild", "sum", "n"}


def merge_parts(rows: DataFrame, names: Iterable[str] | None = None) -> list[Column]:
    """Aggregates that combine the parts of several rows into those of their union; all parts, or those of
    the named means."""
    kept = [c for c in rows.columns if is_part(c)]
    if names is not None:
        wanted = set(names)
        kept = [c for c in kept if c.rsplit(PART, 1)[0] in wanted]
    return [F.expr(f"sum(`{c}`) AS `{c}`") for c in kept]


def finished(rows: DataFrame, names: Iterable[str], *, sums: bool = False) -> DataFrame:
    """``rows`` with means (or ``sums``) in place of the parts of the named ones.

    A mean is 0.0 where no input was non-null, a sum is NULL there.
    """
    kept = [f"`{c}`" for c in rows.columns if not is_part(c)]
    working, figures = [], []
    for name in names:
        total = _column(name, "sum")
        if f"{name}{PART}wild" in rows.columns:
            working += _exact_total(name)
            total = _column(name, "total")
        total = f"cast({total} AS double)"
        mean = f"coalesce({total} / nullif({_column(name, 'n')}, 0), 0D)"
        figures.append(f"{total if sums else mean} AS `{name}`")
    return rows.selectExpr("*", *working).selectExpr(*kept, *figures)


def _exact_total(name: str) -> list[str]:
    """Columns that lead to ``<name>__total``, the double nearest to the exact sum, each from those before.

    Pieces are joined in three whole numbers: of 2**-7, of 2**-57, and of 2**-82. The lower two are then brought
    into the range from 0 to one of the next unit, as digits are. Of the digits a decimal holds either all or
    over 55 bits; one more bit says whether anything follows, which is all that rounding to 53 bits needs.
    """
    unit, part = f"{2 ** (2 * WIDTH)}BD", f"{2**WIDTH}BD"

    def c(key: str) -> str:
        return _column(name, key)

    def joined(high: str, low: str) -> str:
        return f"cast({c(high)} AS decimal(38,0)) * {part} + cast({c(low)} AS decimal(38,0))"

    def carry(amount: str, size: str) -> str:
        return f"({amount} - pmod({amount}, {size})) div {size}"

    a, b, d = c("units"), c("small"), c("least")
    nearest = (
        f"CASE WHEN {a} >= {2**55}BD THEN cast({a} * 2 + IF({b} > 0 OR {d} > 0, 1, 0) AS double) / {2.0**8!r}D"
        f" WHEN {a} >= {part} THEN cast(({a} * {unit} + {b}) * 2 + IF({d} > 0, 1, 0) AS double) / {2.0**58!r}D"
        f" ELSE cast(({a} * {unit} + {b}) * {part} + {d} AS double) / {2.0**82!r}D END"
    )
    steps = {
        "first": joined("s0", "s1"),
        "second": joined("s2", "s3"),
        "third": f"cast({c('s4')} AS decimal(38,0))",
        # The sign of the whole is that of the units once the lower two are not negative.
        "low": f"{c('second')} + {carry(c('third'), part)}",
        "side": f"IF({c('first')} + {carry(c('low'), unit)} < 0, -1, 1)",
        "carried": f"{c('second')} * {c('side')} + {carry(f"({c('third')} * {c('side')})", part)}",
        "least": f"pmod({c('third')} * {c('side')}, {part})",
        "small": f"pmod({c('carried')}, {unit})",
        "units": f"{c('first')} * {c('side')} + {carry(c('carried'), unit)}",
        "exact": f"{c('side')} * {nearest}",
        "total": f"CASE WHEN {c('wild')} IS NULL THEN {c('exact')} ELSE coalesce({c('exact')}, 0D) + {c('wild')} END",
    }
    return [f"{text} AS {c(key)}" for key, text in steps.items()]
