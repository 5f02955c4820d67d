"""Array helpers built from higher-order functions.

Everything here stays inside one row: no shuffle, no Python worker. The running
totals work in blocks, so a row with very many matches costs close to linear
time instead of quadratic. The longer ones are SQL text, which Spark parses in
one call.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 256
_names = count()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body``.

    Catalyst may inline a projected column into a lambda and evaluate it once
    per element; a lambda variable cannot be inlined.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def let_sql(value: str, body: Callable[[str], str]) -> str:
    name = f"v{next(_names)}"
    return f"transform(array({value}), {name} -> {body(name)})[0]"


def _running_sql(values: str, fold: Callable[[str], str], join: str) -> str:
    def body(vals: str) -> str:
        blocks = (
            f"CASE WHEN size({vals}) > 0 THEN sequence(0, (size({vals}) - 1) DIV {BLOCK}) "
            f"ELSE CAST(array() AS array<bigint>) END"
        )
        sums = f"transform({blocks}, b -> {fold(f'slice({vals}, CAST(b AS INT) * {BLOCK} + 1, {BLOCK})')})"

        def with_sums(s: str) -> str:
            heads = f"transform({s}, (x, b) -> {fold(f'slice({s}, 1, b)')})"
            tail = fold(f"slice({vals}, i - i % {BLOCK} + 1, i % {BLOCK})")
            return let_sql(heads, lambda h: f"transform({vals}, (x, i) -> {join.format(f'{h}[CAST(i DIV {BLOCK} AS INT)]', tail)})")

        return let_sql(sums, with_sums)

    return let_sql(values, body)


def sums_before_sql(values: str) -> str:
    """For each element of a bigint array, the sum of the elements before it."""
    return _running_sql(values, lambda a: f"aggregate({a}, 0L, (acc, x) -> acc + x)", "{} + {}")


def max_before_sql(values: str) -> str:
    """For each element, the largest earlier element, -1 when there is none."""
    return _running_sql(values, lambda a: f"coalesce(array_max({a}), -1L)", "greatest({}, {})")


def sums_before(values: Column, name: str) -> Column:
    """Column form of ``sums_before_sql`` for the column called ``name``."""
    return F.expr(sums_before_sql(name))


def sums_before_of(values: Column) -> Column:
    """The same for any array of whole numbers, as a column, so that it can be used inside other lambdas."""
    def fold(part: Column) -> Column:
        return F.aggregate(part, F.lit(0).cast("bigint"), lambda acc, x: acc + x)

    def body(v: Column) -> Column:
        last = ((F.size(v) - 1) / BLOCK).cast("int")
        blocks = F.when(F.size(v) > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        sums = F.transform(blocks, lambda b: fold(F.slice(v, b * BLOCK + 1, F.lit(BLOCK))))
        heads = let(sums, lambda s: F.transform(s, lambda x, b: fold(F.slice(s, F.lit(1), b))))
        return let(heads, lambda h: F.transform(
            v, lambda x, i: F.get(h, (i / BLOCK).cast("int")) + fold(F.slice(v, i - i % BLOCK + 1, i % BLOCK))
        ))

    return let(values, body)


def first_by(values: Column, key: Callable[[Column], Column], order: Callable[[Column], Column]) -> Column:
    """Keep, for each key, the element that comes first by ``order``."""
    keyed = F.array_sort(F.transform(values, lambda x: F.struct(key(x).alias("k"), order(x).alias("o"), x.alias("x"))))
    return let(
        keyed,
        lambda ks: F.transform(
            F.filter(ks, lambda x, i: (i == 0) | ~F.get(ks, i - 1)["k"].eqNullSafe(x["k"])),
            lambda x: x["x"],
        ),
    )


def newlines(text: Column) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))


def after_last_newline(text: Column) -> Column:
    return F.length(F.substring_index(text, "\n", -1))


def newlines_sql(text: str) -> str:
    return f"(octet_length({text}) - octet_length(replace({text}, '\\n', '')))"


def after_last_newline_sql(text: str) -> str:
    return f"length(substring_index({text}, '\\n', -1))"
