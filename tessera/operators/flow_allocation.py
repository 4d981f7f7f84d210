"""Allocation of counted units to replacements, per independent pair."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def max_flow_events(events: list[tuple[str, str, str]], decreases: dict[str, int], increases: dict[str, int]) -> set[str]:
    """Ids of events in one maximum flow source -> old -> event -> new -> sink.

    Old ids hold as many units as they lost, new ids as many as they gained,
    each event one.  Augmenting paths are searched in sorted order, so equal
    input gives equal output.
    """
    events = sorted(events)
    by_old: dict[str, list[int]] = {}
    for i, (_, old, _) in enumerate(events):
        by_old.setdefault(old, []).append(i)
    used_old: dict[str, int] = {}
    holder: dict[str, list[int]] = {}  # new id -> events that hold a unit of it
    chosen: set[int] = set()

    def augment(start: int) -> bool:
        """Give ``start`` a unit, moving others to events of the same old id."""
        if start in chosen or used_old.get(events[start][1], 0) >= decreases.get(events[start][1], 0):
            return False
        came: dict[int, tuple[int, int] | None] = {start: None}  # event -> (event before, event that gives way)
        queue = deque([start])
        while queue:
            i = queue.popleft()
            new = events[i][2]
            if len(holder.get(new, [])) < increases.get(new, 0):
                while True:
                    chosen.add(i)
                    holder.setdefault(events[i][2], []).append(i)
                    if came[i] is None:
                        used_old[events[i][1]] = used_old.get(events[i][1], 0) + 1
                        return True
                    i, gone = came[i]
                    chosen.discard(gone)
                    holder[events[gone][2]].remove(gone)
            for j in holder.get(new, []):
                for k in by_old[events[j][1]]:
                    if k not in chosen and k not in came:
                        came[k] = (i, j)
                        queue.append(k)
        return False

    # An event that gave way may get a unit again later.
    while any([augment(i) for i in range(len(events))]):
        pass
    return {events[i][0] for i in chosen}


def allocate_replacements(events: DataFrame, counts: DataFrame, pair: str) -> DataFrame:
    """``pair, event, allocated`` for ``events(pair, event, old_id, new_id)``.

    ``counts(pair, id, n_old, n_new)`` gives the units lost and gained.  Pairs
    are independent groups; events enter a group already reduced to one row per
    (pair, event).
    """
    keyed = events.select(pair, "event", "old_id", "new_id").distinct()
    delta = counts.select(F.col(pair).alias("__pair"), "id", (F.col("n_new") - F.col("n_old")).alias("delta")).where(F.col("delta") != 0)

    def run(key, ev: pd.DataFrame, dl: pd.DataFrame) -> pd.DataFrame:
        down = {i: -int(d) for i, d in zip(dl["id"], dl["delta"]) if d < 0}
        up = {i: int(d) for i, d in zip(dl["id"], dl["delta"]) if d > 0}
        taken = max_flow_events(list(zip(ev["event"], ev["old_id"], ev["new_id"])), down, up)
        return pd.DataFrame({pair: ev[pair], "event": ev["event"], "allocated": [e in taken for e in ev["event"]]})

    kind = events.schema[pair].dataType.simpleString()
    return keyed.groupBy(pair).cogroup(delta.groupBy("__pair")).applyInPandas(run, f"{pair} {kind}, event string, allocated boolean")


def max_flow_units(edges: list[tuple[str, str, int]], decreases: dict[str, int], increases: dict[str, int]) -> dict[tuple[str, str], int]:
    """Units per (old, new) edge in one maximum flow source -> old -> new -> sink.

    Edges hold up to their capacity, ids as many units as they lost or gained.
    Each search for an augmenting path sends as much as the path holds.
    """
    room = {(o, n): c for o, n, c in sorted(edges) if c > 0}
    flow = dict.fromkeys(room, 0)
    out_of: dict[str, list[str]] = {}
    into: dict[str, list[str]] = {}
    for o, n in room:
        out_of.setdefault(o, []).append(n)
        into.setdefault(n, []).append(o)
    left, wanted = dict(decreases), dict(increases)
    while True:
        came: dict[tuple[str, str], tuple[str, str] | None] = {("old", o): None for o in sorted(out_of) if left.get(o, 0) > 0}
        queue, end = deque(came), None
        while queue and end is None:
            side, i = node = queue.popleft()
            if side == "new" and wanted.get(i, 0) > 0:
                end = node
                break
            steps = [("new", n) for n in out_of[i] if flow[i, n] < room[i, n]] if side == "old" else [("old", o) for o in into[i] if flow[o, i] > 0]
            for step in steps:
                if step not in came:
                    came[step] = node
                    queue.append(step)
        if end is None:
            return {e: f for e, f in flow.items() if f}
        path = [end]
        while came[path[-1]] is not None:
            path.append(came[path[-1]])
        path.reverse()
        hops = list(zip(path, path[1:]))
        units = min([left[path[0][1]], wanted[end[1]], *(room[a[1], b[1]] - flow[a[1], b[1]] if a[0] == "old" else flow[b[1], a[1]] for a, b in hops)])
        for a, b in hops:
            if a[0] == "old":
                flow[a[1], b[1]] += units
            else:
                flow[b[1], a[1]] -= units
        left[path[0][1]] -= units
        wanted[end[1]] -= units


def allocate_units(edges: DataFrame, counts: DataFrame, pair: str) -> DataFrame:
    """``pair, old_id, new_id, capacity, units`` for ``edges(pair, old_id, new_id, capacity)``.

    ``counts`` as in ``allocate_replacements``.  Edges of a pair are summed first,
    so a group holds one row per two ids, however many events lie behind it.
    """
    summed = edges.groupBy(pair, "old_id", "new_id").agg(F.sum("capacity").cast("long").alias("capacity"))
    delta = counts.select(F.col(pair).alias("__pair"), "id", (F.col("n_new") - F.col("n_old")).alias("delta")).where(F.col("delta") != 0)

    def run(key: tuple, ev: pd.DataFrame, dl: pd.DataFrame) -> pd.DataFrame:
        down = {i: -int(d) for i, d in zip(dl["id"], dl["delta"]) if d < 0}
        up = {i: int(d) for i, d in zip(dl["id"], dl["delta"]) if d > 0}
        units = max_flow_units(list(zip(ev["old_id"], ev["new_id"], ev["capacity"].astype(int))), down, up)
        return pd.DataFrame({pair: ev[pair], "old_id": ev["old_id"], "new_id": ev["new_id"], "capacity": ev["capacity"], "units": [units.get(k, 0) for k in zip(ev["old_id"], ev["new_id"])]})

    kind = edges.schema[pair].dataType.simpleString()
    return summed.groupBy(pair).cogroup(delta.groupBy("__pair")).applyInPandas(run, f"{pair} {kind}, old_id string, new_id string, capacity long, units long")
