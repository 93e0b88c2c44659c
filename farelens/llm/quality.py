"""Quality rules: base counts of each text, then robust multivariate outliers, DataFrame functions only.

Within each (language, source) group the transformed statistics of the texts that pass the base rule
are fitted by the minimum covariance determinant: the three quarters of the rows that lie closest
to the centre give mean and covariance, and concentration steps repeat this until the fit changes no more. A row
is rejected if its squared Mahalanobis distance is above a chi-squared quantile.

- A step is one pass: rows are added up by group and bin of distance (count, sums, sums of products), and the sums
  of the bins that make up the closest three quarters are added up again. No row is measured twice, sorted, or
  moved to another task. A group whose fit has settled takes no part in later steps.
- All sums are taken over whole numbers (statistics in units of 1/1000), so they do not depend on the order of
  tasks. Statistics are at most 100 for that reason.
- The covariance of the closest three quarters of a normal sample is too small by a known factor (``CONSISTENCY``),
  by which it is multiplied, so squared distances of regular rows follow the chi-squared distribution.
- Each variance has a floor added to it. Statistics that are zero in nearly all texts would otherwise have
  no spread at all and reject the first text that differs.
- Groups with few rows take the estimate of their language, then that of all rows, in this order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farelens.llm.common import BLANKS, stored, words

SYMBOLS = "#*$%&|<>"
UNIT = 1000
# Statistic: least standard deviation.
STATISTICS = {
    "length": 0.5,  # log of the number of words
    "word_chars": 0.4,  # mean code points of a word
    "symbols": 0.01,  # share of symbols among the code points of words
    "shouts": 0.01,  # share of ! and ? among them
    "capitals": 0.05,  # share of upper-case letters among them, of any script
    "copied_lines": 0.10,  # share of lines that repeat an earlier one
    "repeats": 0.05,  # share of words in repeated windows
}
SHARE = 0.75  # of the rows of a group that a fit is made from
# SHARE / P(chi-squared of 9 degrees of freedom <= q), where q is the SHARE quantile of that of 7.
CONSISTENCY = 1.3247
LEAST_ROWS = 60  # of a group for a fit of its own
CUTOFF = 42.0  # squared distance; chi-squared with 7 degrees of freedom exceeds it once in 2 million
MOST = 100  # of a statistic
BINS_PER_UNIT = 20  # of the log of squared distances
WINDOW_WORDS = 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
OWN = "_q_"


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def repeated_words(ws: Column) -> Column:
    """How many words lie in windows of five words that occur at least twice in ``ws``.

    Windows are compared by 64-bit fingerprint inside one text. Texts without a repeat, which are most,
    only pay for the comparison of two sizes.
    """
    starts = F.sequence(F.lit(0), F.size(ws) - WINDOW_WORDS)
    prints = F.transform(starts, lambda i: F.xxhash64(*[F.get(ws, i + k) for k in range(WINDOW_WORDS)]))

    # Arrays are bound to lambda variables, so that each is built once a row.
    counted = F.transform(
        F.array(prints),
        lambda found: F.when(F.size(F.array_distinct(found)) == F.size(found), F.lit(0)).otherwise(
            F.transform(
                F.array(F.array_sort(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
                lambda ordered: F.transform(
                    F.array(F.array_sort(_repeated_places(ordered))), lambda places: _covered(places)
                )[0],
            )[0]
        ),
    )[0]
    return F.when(F.size(ws) > WINDOW_WORDS, counted).otherwise(F.lit(0)).cast("long")


def _repeated_places(ordered: Column) -> Column:
    """Starts of windows whose fingerprint is that of a neighbour in the order of fingerprints."""
    marked = F.transform(
        ordered,
        lambda x, k: F.when(
            (F.get(ordered, k - 1)["h"] == x["h"]) | (F.get(ordered, k + 1)["h"] == x["h"]), x["i"]
        ),
    )
    return F.filter(marked, lambda i: i.isNotNull())


def _covered(places: Column) -> Column:
    steps = F.zip_with(
        places,
        F.slice(places, F.lit(2), F.size(places)),
        lambda a, b: F.coalesce(F.least(b - a, F.lit(WINDOW_WORDS)), F.lit(WINDOW_WORDS)),
    )
    return F.aggregate(steps, F.lit(0), lambda total, step: total + step)


def base_counts(docs: DataFrame, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and for each row n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, plus the counts of lines with a word, of ``!?`` and of capitals for the fit. NULL counts as the empty
    text.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != "")
    solid = _without(text, BLANKS)
    counted = docs.select(
        *keep,
        words(F.col(text_col)).alias(OWN + "words"),
        F.length(solid).cast("long").alias("word_chars"),
        (F.length(text) - F.length(_without(text, SYMBOLS))).cast("long").alias("n_symbols"),
        F.transform(F.array(lines), lambda all_lines: F.size(all_lines))[0].cast("long").alias(OWN + "lines"),
        F.transform(F.array(lines), lambda all_lines: F.size(all_lines) - F.size(F.array_distinct(all_lines)))[0]
        .cast("long")
        .alias("n_dup_lines"),
        (F.length(text) - F.length(_without(text, "!?"))).cast("long").alias(OWN + "shouts"),
        (F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}+", ""))).cast("long").alias(OWN + "capitals"),
    ).select(
        *keep,
        F.size(OWN + "words").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        repeated_words(F.col(OWN + "words")).alias("n_repeat_words"),
        *[OWN + c for c in ("lines", "shouts", "capitals")],
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def _statistics() -> dict[str, Column]:
    """Each statistic in whole units of 1/1000, ``MOST`` at most."""

    def share(part: str, whole: str) -> Column:
        return F.col(part) / F.greatest(F.col(whole), F.lit(1))

    values = {
        "length": F.log1p(F.col("n_words").cast("double")),
        "word_chars": share("word_chars", "n_words"),
        "symbols": share("n_symbols", "word_chars"),
        "shouts": share(OWN + "shouts", "word_chars"),
        "capitals": share(OWN + "capitals", "word_chars"),
        "copied_lines": share("n_dup_lines", OWN + "lines"),
        "repeats": share("n_repeat_words", "n_words"),
    }
    return {name: F.least(F.round(value * UNIT), F.lit(MOST * UNIT)).cast("long") for name, value in values.items()}


NAMES = tuple(STATISTICS)
SIZE = len(NAMES)
PAIRS = [(i, j) for i in range(SIZE) for j in range(i + 1)]
SUMS = ["n", *[f"s{i}" for i in range(SIZE)], *[f"p{i}_{j}" for i, j in PAIRS]]


def squared_distance(fit: str = "fit") -> str:
    """SQL of the squared Mahalanobis distance of a row under ``fit``, a record of ``mean`` and ``inverse``."""
    centred = [f"(x_{name} / {UNIT}D - {fit}.mean[{i}])" for i, name in enumerate(NAMES)]
    terms = [
        f"{1 if i == j else 2} * {fit}.inverse[{i * SIZE + j}] * {centred[i]} * {centred[j]}" for i, j in PAIRS
    ]
    return f"greatest({' + '.join(terms)}, 0D)"


def _inverse(matrix: str) -> str:
    """SQL of the inverse of a positive definite matrix, an array row by row: one Gauss-Jordan step a diagonal
    entry. The floors keep each of these entries away from zero."""
    row, column, pivot = f"(ij div {SIZE})", f"(ij % {SIZE})", f"a[int(k * {SIZE + 1})]"
    left, above = f"a[int({row} * {SIZE} + k)]", f"a[int(k * {SIZE} + {column})]"
    step = (
        f"CASE WHEN {row} = k AND {column} = k THEN 1 / v WHEN {row} = k THEN v / {pivot}"
        f" WHEN {column} = k THEN -v / {pivot} ELSE v - {left} * {above} / {pivot} END"
    )
    return f"aggregate(sequence(0, {SIZE - 1}), {matrix}, (a, k) -> transform(a, (v, ij) -> {step}))"


def fits_of(sums: DataFrame) -> DataFrame:
    """``(group, fit)`` from the count, sums and sums of products of the rows that a fit is made from."""
    variances = [STATISTICS[name] ** 2 for name in NAMES]

    def covariance(i: int, j: int) -> str:
        i, j = max(i, j), min(i, j)
        floor = variances[i] if i == j else 0.0
        spread = f"(p{i}_{j} / n - (s{i} / n) * (s{j} / n)) / {float(UNIT**2)!r}D"
        return f"{spread} * {CONSISTENCY!r}D + {floor!r}D"

    matrix = ", ".join(covariance(i, j) for i in range(SIZE) for j in range(SIZE))
    means = ", ".join(f"s{i} / n / {UNIT}D" for i in range(SIZE))
    return sums.selectExpr("group", f"array({means}) AS mean", f"array({matrix}) AS c").selectExpr(
        "group", f"struct(mean, {_inverse('c')} AS inverse) AS fit"
    )


def _start(rows: DataFrame) -> DataFrame:
    """First fits: medians, and spreads from the quartiles, without correlation.

    Statistics are whole thousandths with a limit, so the exact quartiles count few distinct values a group.
    """
    quartiles = [f"percentile(x_{name}, array(0.25, 0.5, 0.75)) AS q{i}" for i, name in enumerate(NAMES)]
    found = rows.groupBy("group").agg(*[F.expr(q) for q in quartiles])
    means = ", ".join(f"q{i}[1] / {UNIT}D" for i in range(SIZE))

    def entry(i: int, j: int) -> str:
        if i != j:
            return "0D"
        spread = f"(q{i}[2] - q{i}[0]) / {1.349 * UNIT!r}D"
        return f"1 / ({spread} * {spread} + {STATISTICS[NAMES[i]] ** 2!r}D)"

    inverse = ", ".join(entry(i, j) for i in range(SIZE) for j in range(SIZE))
    return found.selectExpr("group", f"struct(array({means}) AS mean, array({inverse}) AS inverse) AS fit")


def step(rows: DataFrame, fits: DataFrame) -> DataFrame:
    """One concentration step: ``(group, fit)`` of the rows of each group that are closest under ``fits``, up to the
    bin of distances that completes ``SHARE`` of the group."""
    measured = rows.join(fits, "group").selectExpr(
        "group", *[f"x_{name}" for name in NAMES], f"int(ln(1 + {squared_distance()}) * {BINS_PER_UNIT}) AS bin"
    )
    sums = [f"sum(x_{name}) AS s{i}" for i, name in enumerate(NAMES)]
    sums += [f"sum(x_{NAMES[i]} * x_{NAMES[j]}) AS p{i}_{j}" for i, j in PAIRS]
    bins = measured.groupBy("group", "bin").agg(F.expr("count(1) AS n"), *[F.expr(s) for s in sums])
    before = "sum(n) OVER (PARTITION BY group ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n"
    whole = "sum(n) OVER (PARTITION BY group)"
    closest = bins.selectExpr("*", f"{before} AS before", f"{whole} AS whole").where(f"before < {SHARE!r}D * whole")
    return fits_of(closest.groupBy("group").agg(*[F.expr(f"sum({c}) AS {c}") for c in SUMS]))


def robust_fits(rows: DataFrame) -> DataFrame:
    """``(group, fit)``: the minimum-covariance-determinant fit of each group of ``rows`` (group, x_...).

    A group has settled when a step leads to a fit that it had before: the same, or, since rows are taken by
    whole bins of distances, one of a few that alternate. Others go on.
    """
    open_ = stored(_start(rows).withColumn("seen", F.array(F.xxhash64("fit"))))
    settled = None
    while True:
        new = step(rows, open_.select("group", "fit")).withColumn("mark", F.xxhash64("fit"))
        moved = stored(
            new.join(open_.select("group", "seen"), "group").selectExpr(
                "group", "fit", "array_contains(seen, mark) AS done", "concat(seen, array(mark)) AS seen"
            )
        )
        done = moved.where("done").select("group", "fit")
        settled = done if settled is None else settled.union(done)
        open_ = moved.where("NOT done").select("group", "fit", "seen")
        if open_.isEmpty():
            return stored(settled)


def _groups(lang: Column, source: Column) -> list[Column]:
    """Names of the groups a row belongs to, the finest first. NULL is apart from every text."""
    named = [F.coalesce(F.concat(F.lit("="), c), F.lit("-")) for c in (lang, source)]
    return [F.to_json(F.array(*named)), F.to_json(F.array(named[0])), F.lit("[]")]


def _choices(sound: DataFrame, least_rows: int) -> DataFrame:
    """``(g0, group)``: for each finest group the finest of its groups with ``least_rows`` rows."""
    sizes = sound.groupBy("g0", "g1", "g2").agg(F.count(F.lit(1)).alias("n0"))
    rough = [f"sum(n0) OVER (PARTITION BY g{k}) AS n{k}" for k in (1, 2)]
    chosen = "".join(f" WHEN n{k} >= {int(least_rows)} THEN g{k}" for k in range(3))
    return sizes.selectExpr("*", *rough).selectExpr("g0", f"CASE{chosen} END AS group")


def _judged(
    docs: DataFrame, keep: list[str], text_col: str, lang_col: str, source_col: str, cutoff: float, least_rows: int
) -> DataFrame:
    """The columns ``keep`` as the record ``_q_row``, with the base counts, base_failed, d2 and kept of each row.

    The verdict is found on the row itself, whatever its id.
    """
    levels = _groups(F.col(lang_col).cast("string"), F.col(source_col).cast("string"))
    row = F.struct(*[F.col(f"`{c}`") for c in keep])
    named = docs.select(
        row.alias(OWN + "row"), F.col(text_col).alias(OWN + "text"), *[g.alias(f"g{k}") for k, g in enumerate(levels)]
    )
    counted = base_counts(named, text_col=OWN + "text", keep=(OWN + "row", "g0", "g1", "g2"))
    rows = stored(counted.select("*", *[value.alias("x_" + name) for name, value in _statistics().items()]))
    statistics = ["x_" + name for name in NAMES]
    sound = rows.where("NOT base_failed").select("g0", "g1", "g2", *statistics)
    choices = stored(_choices(sound, least_rows).where("group IS NOT NULL"))
    # A row counts in each of its groups that some row will be judged by.
    wanted = choices.select("group").distinct()
    every = sound.select(F.explode(F.array("g0", "g1", "g2")).alias("group"), *statistics)
    fits = robust_fits(stored(every.join(wanted, "group", "left_semi")))
    # Stored, so that Spark knows how small it is and need not move rows, which may carry texts, to join it.
    own = stored(choices.join(fits, "group").select(F.col("g0").alias("of"), "fit"))
    measured = rows.join(own, F.col("g0") == F.col("of"), "left")
    distance = F.when(~F.col("base_failed") & F.col("fit").isNotNull(), F.expr(squared_distance()))
    verdict = ~F.col("base_failed") & F.coalesce(F.col("d2") <= cutoff, F.lit(True))
    return measured.withColumn("d2", distance).withColumn("kept", verdict)


def judge(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    cutoff: float = CUTOFF,
    least_rows: int = LEAST_ROWS,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, the base counts, base_failed, distance, kept.

    ``kept`` is false where base_failed, else true unless the squared distance is above ``cutoff``. A group
    of language and source with less than ``least_rows`` rows that pass the base rule is judged by its
    language's fit, then by that of all rows.

    NULL and blank texts have no words and fail the base rule; a NULL language or source is a group of
    its own; repeated rows count each; with too few rows for any fit all that pass the base rule are
    kept; an empty table gives an empty result. Other columns of ``docs`` are ignored.
    """
    judged = _judged(docs, [id_col], text_col, lang_col, source_col, cutoff, least_rows)
    named = F.col(OWN + "row")[id_col].alias("doc_id")
    return judged.select(named, *COUNTS, "base_failed", F.sqrt("d2").alias("distance"), "kept")


def drop_rejected(
    docs: DataFrame,
    *,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    cutoff: float = CUTOFF,
    least_rows: int = LEAST_ROWS,
) -> DataFrame:
    """The rows of ``docs`` that :func:`judge` keeps, each judged by itself, whatever its id."""
    judged = _judged(docs, docs.columns, text_col, lang_col, source_col, cutoff, least_rows)
    return judged.where("kept").select(OWN + "row.*")
