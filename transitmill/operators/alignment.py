"""Monotone alignment: an ordered run of observations onto an ordered chain of places, by dynamic programming."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import ship

#: Rows of a part, at least.
PART = 5000
#: Candidates an observation from which least_span is tried before best_chain; the result is the same.
MANY = 6


def best_chain(candidates: list[list[tuple[int, float]]], strict: bool = False) -> list[int | None]:
    """For each observation the number of its chosen candidate (place, position), or None if it is left out.

    Positions never fall along the run (strict: always rise). Of all ways to do that, the one taken places most observations,
    then spans fewest places from its first to its last, then ends first; where two beginnings are as good, the one that has come
    less far is taken, then the earlier one. Only states that no other one beats matter: by rising position their value rises
    too, so each observation looks up one predecessor, and n observations take about n log n steps.
    """
    before = bisect_left if strict else bisect_right
    positions: list[float] = []
    states: list[tuple[int, int, int]] = []  # observations placed, first place, node
    nodes: list[tuple[int, int, int]] = []  # observation, candidate, node before
    for k, own in enumerate(candidates):
        reached = []
        for j in sorted(range(len(own)), key=lambda j: (own[j][1], own[j][0])):
            place, at = own[j]
            i = before(positions, at) - 1
            n, first, prev = states[i] if i >= 0 else (0, place, -1)
            reached.append((at, n + 1, first, len(nodes)))
            nodes.append((k, j, prev))
        for at, n, first, node in reached:
            i = bisect_right(positions, at)
            if i and states[i - 1][:2] >= (n, first):
                continue
            lo = i - 1 if i and positions[i - 1] == at else i
            hi = i
            while hi < len(states) and states[hi][:2] <= (n, first):
                hi += 1
            positions[lo:hi], states[lo:hi] = [at], [(n, first, node)]
    out: list[int | None] = [None] * len(candidates)
    if states:
        ends = [(n, first - candidates[nodes[node][0]][nodes[node][1]][0], -at, -nodes[node][0], node) for at, (n, first, node) in zip(positions, states, strict=True)]
        node = max(ends)[-1]
        while node >= 0:
            k, j, node = nodes[node]
            out[k] = j
    return out


def least_span(places: list[np.ndarray], positions: list[np.ndarray], strict: bool = False) -> list[int] | None:
    """best_chain's choice if every observation can be placed, else None. An observation's places rise, and its positions don't fall.

    From each candidate of the first observation the way goes to the nearest candidate of the next one, all ways at once, so that
    an observation takes a search of as many places as there are ways, whatever lies between.
    """
    side = "right" if strict else "left"
    starts = np.flatnonzero(np.append(positions[0][1:] != positions[0][:-1], True))
    ways, now = [starts], positions[0][starts]
    for at in positions[1:]:
        nearest = np.searchsorted(at, now, side)
        nearest = nearest[: np.searchsorted(nearest, len(at))]  # later starts run out of places first
        if not len(nearest):
            return None
        ways.append(nearest)
        now = at[nearest]
    last = ways[-1]
    best = int((places[-1][last] - places[0][starts[: len(last)]]).argmin())
    return [int(way[best]) for way in ways]


def chosen(places: list[np.ndarray], positions: list[np.ndarray], strict: bool = False) -> list[int | None]:
    """best_chain of arrays; an observation without candidates is left out."""
    held = [k for k, own in enumerate(places) if len(own)]
    out: list[int | None] = [None] * len(places)
    if not held:
        return out
    found = None
    if sum(len(places[k]) for k in held) >= MANY * len(held) and all((np.diff(positions[k]) >= 0).all() for k in held):
        found = least_span([places[k] for k in held], [positions[k] for k in held], strict)
    if found is None:
        found = best_chain([list(zip(places[k].tolist(), positions[k].tolist(), strict=True)) for k in held], strict)
    for k, j in zip(held, found, strict=True):
        out[k] = j
    return out


def by_runs(rows: DataFrame, places: DataFrame, keys: list[str], run: list[str], order: list[Column], align: Callable, added: str) -> DataFrame:
    """rows with the columns `added` that `align` gives: align(places of the keys) is called once a part, and what it returns once for each
    run, with the run's rows as lists by column, in rising `order`; it gives lists of the new columns' values, in order.

    A row carries no candidates: the rows of keys are dealt by runs to parts of about as many rows as the keys have places (PART
    at least), and each part gets all of the places once. So places are copied at most once a row, and a task holds one part. A run
    stays whole. Rows of keys without places get empty ones.
    """
    ship(rows.sparkSession)
    own = rows.columns
    sized = places.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).join(sized, keys, "left")
    parts = counts.select(*[F.col(c).alias(f"_key_{c}") for c in keys], F.ceil(F.col("_rows") / F.greatest(F.lit(PART), F.coalesce("_size", F.lit(0)))).alias("_parts"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_key_{c}")) for c in keys])
    dealt = rows.join(F.broadcast(parts), same).select(*own, *[c.alias(f"_order{i}") for i, c in enumerate(order)], F.pmod(F.xxhash64(*run), "_parts").alias("_part"))
    copies = places.join(F.broadcast(parts), reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_key_{c}") for c in keys]))
    copies = copies.select(*[F.col(c).cast(rows.schema[c].dataType).alias(c) if c in keys else c for c in places.columns], F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)).alias("_part"))
    kinds = StructType.fromDDL(added)
    schema = StructType([*[rows.schema[c] for c in own], *kinds])
    target = to_arrow_schema(kinds)
    orders = [(f"_order{i}", "ascending") for i in range(len(order))]

    def part(given: pa.Table, chains: pa.Table) -> pa.Table:
        number = np.zeros(given.num_rows, np.int64)
        for c in run:
            code = given[c].combine_chunks().dictionary_encode("encode").indices.to_numpy()
            number = np.unique(number * (int(code.max(initial=0)) + 1) + code, return_inverse=True)[1]
        given = given.append_column("_run", pa.array(number))
        given = given.take(pc.sort_indices(given, sort_keys=[("_run", "ascending"), *orders], null_placement="at_start"))
        number = given["_run"].to_numpy()
        ends = np.append(np.flatnonzero(number[1:] != number[:-1]) + 1, len(number)) if len(number) else []
        values, one, lo, new = {c: given[c].to_pylist() for c in own if c not in keys}, align(chains), 0, [[] for _ in target]
        for hi in ends:
            for held, more in zip(new, one({c: v[lo:hi] for c, v in values.items()}), strict=True):
                held.extend(more)
            lo = hi
        out = given.select(own)
        for f, held in zip(target, new, strict=True):
            out = out.append_column(f, pa.array(held, f.type))
        return out

    return dealt.groupBy(*keys, "_part").cogroup(copies.groupBy(*keys, "_part")).applyInArrow(part, schema)
