"""Buckets that follow the order of an integer id, for work on neighbours without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let_sql

ROWS = 500
WIDE = 256
FINE = 256


def bucket_of(docs: DataFrame, doc_id: str = "doc_id", rows: int = ROWS) -> Column:
    """A column that never falls as the id grows, with about ``rows`` rows to a value and at most WIDE x FINE values.

    Quantiles of the ids, a bounded list, give the wide buckets; within each the range of ids is cut evenly. Null
    ids come below all others, cut by the hash of their text.
    """
    n, low, high = docs.select(F.count(doc_id), F.min(doc_id), F.max(doc_id)).first()
    wide = max(1, min(WIDE, -(-n // rows)))
    fine = max(1, min(FINE, -(-n // (rows * wide))))
    inner = []
    if n and wide > 1:
        found = docs.select(F.col(doc_id).cast("double").alias("v")).approxQuantile("v", [k / wide for k in range(1, wide)], 0.25 / wide)
        inner = sorted(set(found))
    value = f"CAST({doc_id} AS DOUBLE)"
    edges = [float(low or 0), *inner, float(high or 0) + 1]
    listed = lambda xs: "array(" + ", ".join(f"{x!r}D" for x in xs) + ")"
    outer = f"size(filter({listed(inner)}, b -> b <= {value}))" if inner else "0"
    widths = [max(b - a, 1.0) for a, b in zip(edges, edges[1:], strict=False)]

    def within(o: str) -> str:
        step = f"CAST(floor(({value} - {listed(edges[:-1])}[{o}]) / {listed(widths)}[{o}] * {fine}) AS INT)"
        return f"{o} * {fine} + greatest(0, least({fine - 1}, {step}))"

    at = outer if fine == 1 else let_sql(outer, within)
    return F.expr(f"CASE WHEN {doc_id} IS NULL THEN CAST(shiftright(xxhash64(text), 56) AS INT) - 1000 ELSE {at} END")
