"""Column profile: one row per column of a table."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUANTILES = [0.05, 0.25, 0.5, 0.75, 0.95]


# Size of the quantile sketches (ranks are right to about 0.3 %), and log2 of the registers that count distinct
# values (standard error 1.6 %).
SKETCH = 1000
LOG_REGISTERS = 12


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _number(name: str) -> str:
    return f"double({_quoted(name)})"


def _is_number(field: T.StructField) -> bool:
    return isinstance(field.dataType, T.NumericType)


def _array(numbers: Sequence[float]) -> str:
    return f"array({', '.join(f'{q!r}D' for q in numbers)})"


def _plain(i: int, field: T.StructField) -> list[str]:
    """Measures of fixed size, which Spark keeps in generated code."""
    counted = [f"count({_quoted(field.name)}) as n{i}"]
    if not _is_number(field):
        return counted
    x = _number(field.name)
    return [*counted, f"min({x}) as low{i}", f"max({x}) as high{i}", f"avg({x}) as mean{i}", f"stddev({x}) as dev{i}"]


def _larger(i: int, field: T.StructField, exact: bool) -> list[str]:
    """Sketches, and extremes of values of any size."""
    name, found = _quoted(field.name), []
    if not _is_number(field):
        found += [f"string(min({name})) as first{i}", f"string(max({name})) as last{i}"]
    elif not exact:
        # NaN is no value here, and an empty sketch has no quantiles.
        sketch = f"kll_sketch_agg_double(nanvl({_number(field.name)}, null), {SKETCH})"
        found.append(
            f"case when kll_sketch_get_n_double({sketch}) > 0 then "
            f"kll_sketch_get_quantile_double({sketch}, {_array(QUANTILES)}) end as q{i}"
        )
    if not exact:
        value = f"case when {name} is not null then xxhash64({name}) end"
        found.append(f"hll_sketch_estimate(hll_sketch_agg({value}, {LOG_REGISTERS})) as d{i}")
    return found


def _measured(i: int, field: T.StructField, exact: bool, quantiles: Column | None) -> Column:
    """One struct with all measures of a column, null where its type has no such measure."""
    number = _is_number(field)

    def of(name: str, kind: str, present: bool) -> Column:
        return F.col(f"{name}{i}").cast(kind) if present else F.lit(None).cast(kind)

    if quantiles is None:
        quantiles = of("q", "array<double>", number)
    parts = [F.col("rows"), (F.col("rows") - F.col(f"n{i}")).alias("nulls")]
    if not exact:
        parts.append(F.coalesce(F.col(f"d{i}"), F.lit(0)).cast("long").alias("distinct_values"))
    parts += [
        of(short, "double", number).alias(name)
        for short, name in (("low", "min_number"), ("high", "max_number"), ("mean", "mean"), ("dev", "stddev"))
    ]
    parts.append(quantiles.alias("quantiles"))
    parts += [of("first", "string", not number).alias("min_text"), of("last", "string", not number).alias("max_text")]
    return F.struct(F.lit(field.name).alias("column_name"), F.struct(*parts).alias("m"))


def profile(df: DataFrame, exact: bool = False) -> DataFrame:
    """Rows, nulls, distinct values, range, moments and quantiles of each column.

    Two passes side by side: measures of fixed size in generated code, and mergeable sketches for
    quantiles and distinct values. Their wide rows are unfolded to a row per column. ``exact`` finds
    both exactly instead: quantiles by :func:`exact_quantiles`, distinct values in a pass
    that shuffles every different value of every column as text.
    """
    fields = list(df.schema)
    wide = df.agg(F.count(F.lit(1)).alias("rows"), *[F.expr(e) for i, f in enumerate(fields) for e in _plain(i, f)])
    larger = [F.expr(e) for i, f in enumerate(fields) for e in _larger(i, f, exact)]
    if larger:
        wide = wide.crossJoin(df.agg(*larger))  # one row each
    found = exact_quantiles(df, [f.name for f in fields if _is_number(f)]) if exact else {}
    literals = {
        n: F.array(*[F.lit(v) for v in values]) if values else F.lit(None).cast("array<double>")
        for n, values in found.items()
    }
    none = F.lit(None).cast("array<double>")
    named = F.array(
        *[_measured(i, f, exact, literals.get(f.name, none) if exact else None) for i, f in enumerate(fields)]
    )
    profiled = wide.select(F.inline(named)).select("column_name", "m.*")
    if not exact:
        return profiled
    distinct = (
        value_counts(df, df.columns)
        .groupBy("column_name")
        .agg(F.count("value").alias("distinct_values"))
    )
    return profiled.join(distinct, "column_name", "left")


# --- exact quantiles ------------------------------------------------------------------------

# Values between neighbouring marks of a grid over an interval; the grid's own error is a tenth of a step.
GRID = 1000
# An interval with so many rows at most is settled by counting its distinct values.
DIRECT = 100_000


@dataclass(frozen=True)
class _Wanted:
    """The value of a rank and the next one, counted from 0, and the interval that holds both."""

    name: str
    place: int
    rank: int
    share: float
    low: float = -math.inf
    high: float = math.inf
    below: int = 0
    inside: int = 0

    @property
    def interval(self) -> tuple[str, float, float]:
        return self.name, self.low, self.high


def _literal(x: float) -> str:
    return f"double('{x!r}')" if math.isfinite(x) else f"double('{'-' if x < 0 else ''}Infinity')"


def _within(interval: tuple[str, float, float]) -> str:
    name, low, high = interval
    x = f"nanvl({_number(name)}, null)"
    return f"{x} between {_literal(low)} and {_literal(high)}"


def _narrowed(df: DataFrame, wanted: list[_Wanted]) -> list[_Wanted]:
    """Smaller intervals for the same ranks: a pass for the grids, and one to count."""
    intervals = sorted({w.interval for w in wanted})
    marks = [k / GRID for k in range(GRID + 1)]
    grids = df.agg(
        *[
            F.expr(
                f"percentile_approx(case when {_within(v)} then {_number(v[0])} end, {_array(marks)}, {10 * GRID})"
            ).alias(f"g{i}")
            for i, v in enumerate(intervals)
        ]
    ).first()
    grid_of = dict(zip(intervals, grids, strict=True))
    smaller = []
    for w in wanted:
        first = math.floor((w.rank - w.below) / w.inside * GRID) - 1
        last = math.ceil((w.rank + 2 - w.below) / w.inside * GRID) + 1
        grid = grid_of[w.interval]
        low = w.low if first <= 0 else max(w.low, grid[first])
        high = w.high if last >= GRID else min(w.high, grid[last])
        smaller.append(replace(w, low=low, high=high))
    intervals = sorted({w.interval for w in smaller})
    counted = df.agg(
        *[
            F.expr(e).alias(f"{kind}{i}")
            for i, v in enumerate(intervals)
            for kind, e in (
                ("b", f"count_if(nanvl({_number(v[0])}, null) < {_literal(v[1])})"),
                ("n", f"count_if({_within(v)})"),
            )
        ]
    ).first()
    sizes = {v: (counted[f"b{i}"], counted[f"n{i}"]) for i, v in enumerate(intervals)}
    result = []
    for w, old in zip(smaller, wanted, strict=True):
        below, inside = sizes[w.interval]
        holds = below <= w.rank and w.rank + 1 < below + inside + (w.share == 0)
        result.append(replace(w, below=below, inside=inside) if holds else old)
    return result


def _settled(df: DataFrame, wanted: list[_Wanted]) -> dict[_Wanted, float]:
    """The quantiles themselves: distinct values of the intervals are counted and added up in order."""
    intervals = sorted({w.interval for w in wanted})
    pairs = ", ".join(
        f"case when {_within(v)} then named_struct('interval', {i}, 'value', {_number(v[0])}) end"
        for i, v in enumerate(intervals)
    )
    inside = df.select(F.expr(f"inline(filter(array({pairs}), p -> p is not null))"))
    counts = inside.groupBy("interval", "value").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("interval").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumn("end", F.sum("n").over(upto))
    ranks = df.sparkSession.createDataFrame(
        [(intervals.index(w.interval), i, w.rank - w.below, w.rank - w.below + (w.share > 0)) for i, w in enumerate(wanted)],
        "of int, id int, rank long, next long",
    )
    start = F.col("end") - F.col("n")
    hit = placed.join(
        F.broadcast(ranks),  # a row per quantile
        (F.col("interval") == F.col("of")) & (F.col("end") > F.col("rank")) & (start <= F.col("next")),
    )
    ends = hit.groupBy("id").agg(F.min("value").alias("a"), F.max("value").alias("b"))
    found = {r["id"]: (r["a"], r["b"]) for r in ends.collect()}
    return {w: found[i][0] + (found[i][1] - found[i][0]) * w.share for i, w in enumerate(wanted)}


def exact_quantiles(
    df: DataFrame, names: Sequence[str], shares: Sequence[float] = QUANTILES, direct: int = DIRECT
) -> dict[str, list[float]]:
    """For each number column its quantiles, interpolated between neighbouring values; none for a column without values.

    All columns and quantiles at once: a pass lays a grid of approximate quantiles over each interval
    that holds a wanted rank, a second counts the values below and inside the narrower interval around
    it, to a few thousandths of the rows a round. Intervals of at most ``direct`` rows, or
    that get no narrower (few values, many times each), are settled by counting their distinct values. No
    pass shuffles more than that. NaN and null are no values.
    """
    if not names:
        return {}
    counts = df.agg(*[F.expr(f"count(nanvl({_number(n)}, null))").alias(f"n{i}") for i, n in enumerate(names)]).first()
    open_, ready = [], []
    for name, n in zip(names, counts, strict=True):
        for place, share in enumerate(shares if n else ()):
            at = (n - 1) * share
            w = _Wanted(name, place, math.floor(at), at - math.floor(at), inside=n)
            (open_ if n > direct else ready).append(w)
    while open_:
        later = []
        for old, new in zip(open_, _narrowed(df, open_), strict=True):
            done = new.inside <= direct or new.inside >= old.inside or new.low == new.high
            (ready if done else later).append(new)
        open_ = later
    values = _settled(df, ready) if ready else {}
    result: dict[str, list[float]] = {n: [] for n in names}
    for w in sorted(values, key=lambda w: w.place):
        result[w.name].append(values[w])
    return result


def value_counts(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(column_name, value, n): how often each value of each column occurs.

    The table is unfolded to (column, value) pairs; each task counts its own
    pairs before the shuffle, so a frequent value is no hot spot.
    """
    pairs = [
        F.struct(F.lit(n).alias("column_name"), F.col(f"`{n}`").cast("string").alias("value"))
        for n in names
    ]
    long = df.select(F.inline(F.array(*pairs)))
    return long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))


def top_values(df: DataFrame, names: Sequence[str], k: int = 5) -> DataFrame:
    """The k most frequent values of each column: (column_name, value, n, rank).

    The rank filter is applied inside each task before the shuffle, so at most
    k rows per column and task travel.
    """
    counts = value_counts(df, names).filter(F.col("value").isNotNull())
    best = Window.partitionBy("column_name").orderBy(F.col("n").desc(), F.col("value"))
    ranked = counts.select("column_name", "value", "n", F.row_number().over(best).alias("rank"))
    return ranked.filter(F.col("rank") <= k)
