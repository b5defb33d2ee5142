"""Parallel links under the same names, merged into stretches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEGREE_M, DENSIFY_M, OVERLAP_M, OVERLAP_SHARE
from ..session import ship


def metres(line: np.ndarray, lat0: float) -> np.ndarray:
    """Longitude and latitude as metres on a plane that touches at lat0."""
    return line * DEGREE_M * np.array([np.cos(np.radians(lat0)), 1.0])


def overlap(a, b) -> float:
    """Share of the shorter polyline (lon, lat) that lies within OVERLAP_M of the other, in points at most about DENSIFY_M metres
    apart on each of its pieces. The plane touches at the first point of `a`."""
    a, b = np.asarray([list(p) for p in a], float).reshape(-1, 2), np.asarray([list(p) for p in b], float).reshape(-1, 2)
    if min(len(a), len(b)) < 2:
        return 0.0
    length = lambda x: np.hypot(*np.diff(x, axis=0).T)
    short, long = sorted((metres(x, a[0, 1]) for x in (a, b)), key=lambda x: length(x).sum())
    pieces = np.maximum(1, length(short) // DENSIFY_M).astype(int)
    own = np.repeat(np.arange(len(pieces)), pieces)
    part = (np.arange(len(own)) - np.repeat(np.cumsum(pieces) - pieces, pieces) + 1) / pieces[own]
    points = np.concatenate([short[:1], short[own] + part[:, None] * np.diff(short, axis=0)[own]])
    way = np.diff(long, axis=0)
    along = ((points[:, None] - long[:-1]) * way).sum(axis=2) / np.maximum((way * way).sum(axis=1), 1e-12)
    away = points[:, None] - (long[:-1] + np.clip(along, 0, 1)[..., None] * way)
    return float((np.hypot(away[..., 0], away[..., 1]).min(axis=1) <= OVERLAP_M).mean())


def meeting(lines: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Pairs i < j of lines whose boxes come within OVERLAP_M, the only ones that can run along each other: a sweep from south to
    north over the boxes. The margin is twice that, by the metres of a degree where they are least."""
    boxes = np.array([[*x.min(axis=0), *x.max(axis=0)] for x in lines])
    far = np.abs(boxes[:, [1, 3]]).max()
    lon = 2 * OVERLAP_M / (DEGREE_M[0] * np.cos(np.radians(far))) if far < 89 else np.inf
    lat = 2 * OVERLAP_M / DEGREE_M[1]
    order = np.argsort(boxes[:, 1], kind="stable")
    west, south, east, north = boxes[order].T
    last = np.searchsorted(south, north + lat, "right")
    for k, hi in enumerate(last):
        near = np.arange(k + 1, hi)
        near = near[(west[near] <= east[k] + lon) & (east[near] >= west[k] - lon)]
        for n in near:
            yield tuple(sorted((int(order[k]), int(order[n]))))


def merge(links: DataFrame, key: str = "link_key", names: tuple[str, str] = ("from_name", "to_name"), cost: str = "cost", geometry: str = "geometry") -> DataFrame:
    """(link_key, stretch): links of equal names that run along each other, named by the costliest (of equal ones, the least key).

    Only links that share both names meet. Equal geometries are one line, which stands for all of its links, and lines are compared
    only where their boxes come near each other and they aren't yet in one stretch.
    """

    ship(links.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([cost, key], ascending=[False, True]).reset_index(drop=True)
        keys = pdf[key].tolist()
        top = np.arange(len(pdf))
        points = [np.asarray([list(p) for p in x], float).reshape(-1, 2) for x in pdf[geometry]]
        same: dict[bytes, list[int]] = {}
        for k, x in enumerate(points):
            if len(x) > 1 and np.isfinite(x).all():  # a point runs along nothing
                same.setdefault(x.tobytes(), []).append(k)
        groups = list(same.values())  # by their first, the costliest
        lines = [points[g[0]] for g in groups]
        least, most = [min(keys[k] for k in g) for g in groups], [max(keys[k] for k in g) for g in groups]
        above = list(range(len(groups)))

        def root(i: int) -> int:
            while above[i] != i:
                above[i] = i = above[above[i]]
            return i

        for i, j in meeting(lines) if len(lines) > 1 else ():
            a, b = root(i), root(j)
            if a == b:
                continue
            ways = [(x, y) for x, y in ((i, j), (j, i)) if least[x] < most[y]]  # a pair is looked at from its lesser key
            if any(overlap(lines[x], lines[y]) >= OVERLAP_SHARE for x, y in ways):
                above[max(a, b)] = min(a, b)
        for i, g in enumerate(groups):
            top[g] = groups[root(i)][0]
        return pd.DataFrame({key: keys, "stretch": [keys[k] for k in top]})

    kind = links.schema[key].dataType.simpleString()
    return links.select(key, *names, F.col(cost).cast("double").alias(cost), F.coalesce(geometry, F.array()).alias(geometry)).groupBy(*names).applyInPandas(run, f"{key} {kind}, stretch {kind}")
