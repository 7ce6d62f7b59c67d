"""Running aggregates and ordered folds for keys of any size.

Rows are range-partitioned by key and order into a table, so that a key with a third of all
rows spreads over many ranges.  What associates (sums, minima, maxima) is scanned inside
each range and carried over: the totals of earlier ranges of the same key are added.  What
does not is folded range by range from a guessed state and folded again where the
range before ends in another one, until all agree.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from pyspark.sql.types import StructType

from ..sources.scratch import written

COMBINED = {"sum": lambda a, b: a + F.coalesce(b, F.lit(0)), "min": F.least, "max": F.greatest}
TOTAL = {"sum": F.sum, "min": F.min, "max": F.max}


def ranged(df: DataFrame, keys: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """``df`` as a table with ``_range``; ranges ascend with keys and order."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(df.repartitionByRange(n, *keys, *order).withColumn("_range", F.spark_partition_id()), "ranges")


def running(rows: DataFrame, keys: list[str], order: list[str], columns: dict[str, tuple[str, Column]], following: bool = False) -> DataFrame:
    """``rows`` of ``ranged`` with aggregates (name: function and column) from the key's start to each row, or from behind it to the key's end.

    Order must be total.  Nulls do not count; a key may be null.
    """
    inside = Window.partitionBy("_range", *keys).orderBy(*order)
    inside = inside.rowsBetween(1, Window.unboundedFollowing) if following else inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # One row per key and range: at most as many for a key as there are ranges.
    totals = rows.groupBy("_range", *keys).agg(*(TOTAL[f](c).alias(name) for name, (f, c) in columns.items()))
    around = Window.partitionBy(*keys).orderBy("_range")
    around = around.rowsBetween(1, Window.unboundedFollowing) if following else around.rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(F.col("_range").alias("_r"), *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), *(TOTAL[f](name).over(around).alias(f"_c{i}") for i, (name, (f, _)) in enumerate(columns.items())))
    carried = carried.where(" or ".join(f"_c{i} is not null" for i in range(len(columns))))
    own = rows.withColumns({name: TOTAL[f](c).over(inside) for name, (f, c) in columns.items()})
    met = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        met = met & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = own.join(carried, met, "left")
    both = {name: COMBINED[f](F.coalesce(name, F.lit(0)) if f == "sum" else F.col(name), F.col(f"_c{i}")) for i, (name, (f, _)) in enumerate(columns.items())}
    return joined.select(*(both[c].alias(c) if c in both else F.col(c) for c in own.columns))


def by_row(step: Callable[[list[float], object], tuple[list[float], tuple]]) -> Callable:
    """``folded``'s step from one that takes a single row: ``step(state, row)`` gives the state after it and a tuple."""

    def over(held: list[float], columns: dict[str, np.ndarray]) -> tuple[list[float], list]:
        row, given = namedtuple("Row", columns), []
        for values in zip(*(c.tolist() for c in columns.values()), strict=True):
            held, out = step(held, row(*values))
            given.append(out)
        return held, list(zip(*given, strict=True))

    return over


def folded(rows: DataFrame, key: str, order: list[str], schema: str, step: Callable[[list[float], dict[str, np.ndarray]], tuple[list[float], list]], state: str = "array<double>") -> DataFrame:
    """``step(state, columns)``, over the rows of each key in order: the state after some rows and what they give, column by column; a state is a list, empty at first.

    A key's rows come in pieces of any size.  ``rows`` come from ``ranged`` by the key and order.  A range's first key may go on from the range
    before: ranges that begin and end with one key depend on it.  All are folded from an empty
    state at first; then those whose true beginning differs are folded again, at the same
    time, until no end changes.  Where states forget (a limiter's window) this takes few rounds.
    """
    names = StructType.fromDDL(schema).names
    kind = rows.schema[key].dataType.simpleString()
    ends_schema = f"_range int, first {kind}, last {kind}, end {state}"
    given_names = [c for c in rows.columns if c != "_range"]
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def fold(emit: bool):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            at, now, first, held, begun = None, None, None, [], []
            ends, fresh = [], True
            for f in frames:
                out = [[] for _ in names]
                columns = {c: f[c].to_numpy() for c in given_names}
                index, states, codes = f["Index_"].to_numpy(), f["is_state"].to_numpy(dtype=bool), pd.factorize(f[key])[0]
                cut = (index[1:] != index[:-1]) | (codes[1:] != codes[:-1]) | states[1:] | states[:-1]
                bounds = [0, *(np.flatnonzero(cut) + 1).tolist(), len(f)] if len(f) else []
                for a, b in pairwise(bounds):
                    if index[a] != at:
                        if at is not None:
                            ends.append((at, first, now, held))
                        at, fresh, begun, held = int(index[a]), True, [], []
                    if states[a]:
                        begun = list(f["begun"].iat[a])
                        continue
                    k = None if codes[a] < 0 else columns[key][a : a + 1].tolist()[0]
                    if fresh:
                        first, now, held, fresh = k, k, begun, False
                    elif k != now:
                        now, held = k, []
                    held, given = step(held, {c: x[a:b] for c, x in columns.items()})
                    for whole, part in zip(out, given, strict=True) if emit else ():
                        whole.append(part)
                if emit:
                    joined = (np.concatenate(x) if x and isinstance(x[0], np.ndarray) else [v for part in x for v in part] for x in out)
                    yield pd.DataFrame(dict(zip(names, joined, strict=True)), columns=names)
            if not emit:
                if at is not None:
                    ends.append((at, first, now, held))
                yield pd.DataFrame(ends, columns=["_range", "first", "last", "end"])

        return run

    def over(some: DataFrame, starts: DataFrame | None, emit: bool) -> DataFrame:
        shaped = some.withColumn("is_state", F.lit(False)).withColumn("begun", F.lit(None).cast(state))
        if starts is not None:
            shaped = shaped.unionByName(starts.select("_range", F.lit(True).alias("is_state"), "begun"), allowMissingColumns=True)
        dealt = shaped.withColumnRenamed("_range", "Index_").repartitionById(tasks, F.col("Index_")).sortWithinPartitions("Index_", F.desc("is_state"), key, *order)
        return dealt.mapInPandas(fold(emit), schema if emit else ends_schema)

    ends = written(over(rows, None, False), "ends")
    starts = None
    while True:
        # One row per range with rows; the range before may be empty, so neighbours are found by order.
        before = Window.orderBy("_range")
        linked = ends.select("_range", "first", "last", F.lag(F.struct("last", "end")).over(before).alias("p"))
        begun = linked.select("_range", F.when(F.col("p.last") == F.col("first"), F.col("p.end")).alias("begun"), (F.col("first") == F.col("last")).alias("through")).where("size(begun) > 0")
        begun = written(begun, "starts")
        old = starts if starts is not None else begun.limit(0)
        changed = begun.join(old.select("_range", F.col("begun").alias("old")), "_range", "left").where(~F.col("begun").eqNullSafe(F.col("old")))
        lost = old.join(begun.select("_range"), "_range", "left_anti").select("_range", "through")
        todo = [r["_range"] for r in changed.where("through").select("_range").union(lost.where("through").select("_range")).collect()]  # numbers of ranges
        starts = begun
        if not todo:
            return over(rows, starts, True)
        again = over(rows.where(F.col("_range").isin(todo)), starts.where(F.col("_range").isin(todo)), False)
        ends = written(ends.where(~F.col("_range").isin(todo)).unionByName(again), "ends")
