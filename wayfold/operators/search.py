"""Least costs and cheapest paths, a component of the graph in a task.

Components that fit a task are dealt out: many small ones to one, a large one to several that share its origins, so each is searched in memory without
rounds of joins. What a task holds is bounded by MOST_EDGES and MOST_ROWS; components beyond that are left to the searches over whole tables.
"""

from __future__ import annotations

import heapq
import math
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.sources.scratch import stored

#: A component of more edges than MOST_EDGES is no task's; one of more than OWN_EDGES has tasks of its own.
MOST_EDGES, OWN_EDGES = 4_000_000, 5_000
#: What a task is given: edges of small components, edges times origins, and nodes times origins at most (unless a single origin has more).
TASK_EDGES, TASK_WORK, MOST_ROWS = 100_000, 200_000_000, 2_000_000
#: A graph with more arcs a node than this is searched by whole steps, others node by node; so many arcs are looked at at once.
DENSE, AT_ONCE = 8, 1_000_000
#: Edges that are joined into stars at once.
AT_HAND = 1_000_000
MOST_TASKS = 2_000
# Tasks get the code of this module with them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def stars(batches):
    """Join the edges (lo, hi) of a task, AT_HAND at a time, into stars: a row (node, root) for each node, root the least that it is linked to there."""

    def star(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        ends = pa.Table.from_batches(held)
        nodes, at = np.unique(np.concatenate([ends["lo"].to_numpy(), ends["hi"].to_numpy()]), return_inverse=True)
        a, b, root = at[: len(at) // 2], at[len(at) // 2 :], np.arange(len(nodes))
        while True:
            low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
            apart = low < high
            if not apart.any():
                return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], ["node", "root"])
            np.minimum.at(root, high[apart], low[apart])
            while (root[root] < root).any():
                root = root[root]

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= AT_HAND:
            yield star(held)
            held, n = [], 0
    if n:
        yield star(held)


class Graph:
    """Edges of a task as arcs by node, nodes numbered in order of (g, node)."""

    def __init__(self, edges: pa.Table, both: bool = True) -> None:
        a, b = (edges[c].to_numpy() for c in ("a", "b"))
        self.nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        self.copies, g = np.unique(edges["g"].to_numpy(), return_inverse=True)
        self.places, at = np.unique(np.concatenate([g, g]) * len(self.nodes) + at, return_inverse=True)
        a, b = at[: len(a)].astype(np.int32), at[len(a) :].astype(np.int32)
        w, ids = edges["w"].to_numpy(), edges["id"].to_numpy()
        if both:
            a, b, w, ids = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([w, w]), np.concatenate([ids, ids])
        order = np.lexsort((b, a))
        self.n, self.to, self.w, self.ids = len(self.places), b[order], w[order], ids[order]
        self.ptr = np.concatenate([[0], np.cumsum(np.bincount(a, minlength=self.n))])
        self.node = self.nodes[self.places % len(self.nodes)]
        self.dense = len(self.to) > 2 * OWN_EDGES and len(self.to) > DENSE * self.n
        if not self.dense:
            self.lists = self.ptr.tolist(), self.to.tolist(), self.w.tolist()
        else:
            least = self.w[self.w > 0].min(initial=math.inf)
            self.wide = 2.0 ** math.floor(math.log2(max(least, self.w.max() / 64))) if least < math.inf else 1.0

    def at(self, g: np.ndarray, node: np.ndarray) -> np.ndarray:
        """The numbers of nodes, -1 where a copy of the graph does not have one."""
        wanted = np.searchsorted(self.copies, g) * len(self.nodes) + np.minimum(np.searchsorted(self.nodes, node), len(self.nodes) - 1)
        at = np.minimum(np.searchsorted(self.places, wanted), self.n - 1)
        return np.where((self.places[at] == wanted) & (self.node[at] == node), at, -1)

    def costs(self, origin: int, dests: list[int] | None = None, most: float = math.inf):
        """Least costs from an origin by node, as an array or a dict; with dests all that are less than the dearest of them, and theirs."""
        return self._steps(origin, dests, most) if self.dense else self._one_by_one(origin, dests, most)

    def _one_by_one(self, origin, dests, most) -> dict[int, float]:
        ptr, to, w = self.lists
        done, best, heap = {}, {origin: 0.0}, [(0.0, origin)]
        left = None if dests is None else set(dests)
        while heap:
            c, v = heapq.heappop(heap)
            if v in done:
                continue
            done[v] = c
            if left is not None:
                left.discard(v)
                if not left:
                    break
            for i in range(ptr[v], ptr[v + 1]):
                u, d = to[i], c + w[i]
                if d < best.get(u, math.inf) and d <= most:
                    best[u] = d
                    heapq.heappush(heap, (d, u))
        return done

    def _steps(self, origin, dests, most) -> np.ndarray:
        """Nodes are followed in steps of cost, all of a step together, again if they get cheaper within it."""
        cost, followed = np.full(self.n, np.inf), np.full(self.n, np.inf)
        cost[origin] = 0.0
        waiting, steps = {0: [np.array([origin])]}, [0]
        while steps:
            step = heapq.heappop(steps)
            if dests is not None and (cost[dests] < step * self.wide).all():
                break
            now = waiting[step]
            while now:
                front = np.unique(np.concatenate(now))
                front = front[cost[front] < followed[front]]
                now = waiting[step] = []
                followed[front] = cost[front]
                ends = np.cumsum(self.ptr[front + 1] - self.ptr[front])
                for part in np.split(front, np.searchsorted(ends, range(AT_ONCE, int(ends[-1]) if len(ends) else 0, AT_ONCE))):
                    many = self.ptr[part + 1] - self.ptr[part]
                    arcs = np.repeat(self.ptr[part] - (np.cumsum(many) - many), many) + np.arange(many.sum())
                    new, to = np.repeat(cost[part], many) + self.w[arcs], self.to[arcs]
                    less = (new < cost[to]) & (new <= most)
                    to, new = to[less], new[less]
                    np.minimum.at(cost, to, new)
                    to = np.unique(to)
                    at = np.floor(cost[to] / self.wide).astype(np.int64)
                    for s in np.unique(at).tolist():
                        if s not in waiting:
                            waiting[s] = []
                            heapq.heappush(steps, s)
                        waiting[s].append(to[at == s])
            del waiting[step]
        return cost

    def back(self, cost, origin: int, dest: int) -> list[tuple[int, float, int]] | None:
        """The way back from dest: (node, cost, edge to it), the lesser node where ways are equally cheap; None if it was not reached."""
        known = (lambda v: cost[v]) if self.dense else (lambda v: cost.get(v, math.inf))
        if known(dest) == math.inf:
            return None
        way, v = [], dest
        while v != origin:
            lo, hi, c = self.ptr[v], self.ptr[v + 1], known(v)
            if self.dense:
                i = lo + int(np.argmax(cost[self.to[lo:hi]] + self.w[lo:hi] == c))
            else:
                ptr, to, w = self.lists
                i = next(i for i in range(ptr[v], ptr[v + 1]) if known(to[i]) + w[i] == c)
            v = int(self.to[i])
            way.append((v, float(known(v)), i))
        return way


def deal(edges: DataFrame, asked: DataFrame, label: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Deal components out to tasks: (edges with job, asked rows with job, the g and label of components too large for one).

    edges: g, a, b and more; asked: g, origin and more, with origins that are in the graph; label: node, label. Components that nothing is asked of are left out.
    """
    e = edges.join(label.select(F.col("node").alias("a"), "label"), "a")
    q = stored(asked.join(label.select(F.col("node").alias("origin"), "label"), "origin"), "asked")
    rows = q.groupBy("g", "label").agg(F.count("*").alias("_o"))
    e = stored(e.join(rows.select("g", "label"), ["g", "label"], "left_semi"), "edges")
    sizes = e.groupBy("g", "label").agg(F.count("*").alias("_e")).join(rows, ["g", "label"]).join(label.groupBy("label").agg(F.count("*").alias("_n")), "label")
    own = F.col("_e") > OWN_EDGES
    parts = F.ceil(F.greatest(F.col("_e") * F.col("_o") / TASK_WORK, F.col("_n") * F.col("_o") / MOST_ROWS))
    sizes = stored(sizes.withColumn("_parts", F.when(own, F.least(parts, F.col("_o"))).otherwise(F.lit(0)).cast("int")), "sizes")
    fits = sizes.where(F.col("_e") <= MOST_EDGES)
    small = fits.where("_parts = 0").agg(F.sum("_e"), F.sum(F.col("_e") * F.col("_o")), F.sum(F.col("_n") * F.col("_o"))).first()
    few = max(math.ceil((small[0] or 0) / TASK_EDGES), math.ceil((small[1] or 0) / (TASK_WORK / 10)), math.ceil((small[2] or 0) / MOST_ROWS))
    large = fits.agg(F.sum("_parts")).first()[0] or 0
    many = 4 * large
    job = F.when(F.col("_parts") == 0, F.pmod(F.xxhash64("g", "label"), F.lit(max(few, 1)))).otherwise(few + F.pmod(F.xxhash64("g", "label", "_part"), F.lit(max(many, 1))))
    fits = fits.select("g", "label", "_parts")
    dealt = e.join(fits, ["g", "label"]).withColumn("_part", F.explode(F.sequence(F.lit(0), F.greatest(F.col("_parts") - 1, F.lit(0))))).withColumn("job", job)
    asked = q.join(fits, ["g", "label"]).withColumn("_part", F.pmod(F.xxhash64("origin"), F.greatest(F.col("_parts"), F.lit(1))).cast("int")).withColumn("job", job)
    tasks = min(max(few + 2 * large, 1), MOST_TASKS)
    return dealt.drop("_parts", "_part", "label").repartition(tasks, "job"), asked.drop("_parts", "_part", "label").repartition(tasks, "job"), stored(sizes.where(F.col("_e") > MOST_EDGES).select("g", "label"), "large")


def _batches(columns: list[list], schema: pa.Schema) -> pa.Table:
    arrays = [np.concatenate(c) if c else np.array([], dtype=np.int64) for c in columns]
    table = pa.table([pa.array(a).cast(f.type) for a, f in zip(arrays, schema, strict=True)], schema=schema)
    return pa.Table.from_batches(table.to_batches(max_chunksize=200_000), schema=schema)


_COSTS = pa.schema([("g", pa.int32()), ("origin", pa.int64()), ("node", pa.int64()), ("cost", pa.float64())])
_PATHS = pa.schema([("g", pa.int32()), ("origin", pa.int64()), ("dest", pa.int64()), ("back", pa.int64()), ("node", pa.int64()), ("cost", pa.float64()), ("edge", pa.int64())])


def costs(edges: DataFrame, asked: DataFrame, most: float | None = None) -> DataFrame:
    """Least costs from origins to all nodes: g, origin, node, cost. edges, asked: as `deal` gives them."""
    bound = math.inf if most is None else most

    def search(edges: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if edges.num_rows and asked.num_rows:
            graph = Graph(edges)
            g, origins = asked["g"].to_numpy(), asked["origin"].to_numpy()
            for copy, origin, at in zip(g.tolist(), origins.tolist(), graph.at(g, origins).tolist(), strict=True):
                cost = graph.costs(at, most=bound) if at >= 0 else {}
                if isinstance(cost, dict):
                    to, cost = np.fromiter(cost.keys(), np.int64, len(cost)), np.fromiter(cost.values(), np.float64, len(cost))
                else:
                    to = np.flatnonzero(cost < np.inf)
                    cost = cost[to]
                node, cost = (graph.node[to], cost) if at >= 0 else (np.array([origin]), np.zeros(1))
                for c, v in zip(out, (np.full(len(node), copy), np.full(len(node), origin), node, cost), strict=True):
                    c.append(v)
        return _batches(out, _COSTS)

    return edges.select("job", "g", "a", "b", "w", F.lit(0).alias("id")).groupBy("job").cogroup(asked.select("job", "g", "origin").groupBy("job")).applyInArrow(search, "g int, origin long, node long, cost double")


def paths(edges: DataFrame, asked: DataFrame) -> DataFrame:
    """Cheapest paths as in routing.routes, for pairs of different nodes. edges (id, g, a, b, w), asked (g, origin, dest): as `deal` gives them."""

    def search(edges: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in _PATHS]
        if edges.num_rows and asked.num_rows:
            graph = Graph(edges)
            node, ids = graph.node.tolist(), graph.ids
            columns = [asked[c].to_numpy() for c in ("g", "origin", "dest")]
            pairs: dict[tuple[int, int], list[int]] = {}
            for g, origin, dest in zip(columns[0].tolist(), graph.at(*columns[:2]).tolist(), graph.at(columns[0], columns[2]).tolist(), strict=True):
                if origin >= 0 and dest >= 0:
                    pairs.setdefault((g, origin), []).append(dest)
            for (g, origin), dests in pairs.items():
                cost = graph.costs(origin, dests)
                for dest in dests:
                    way = graph.back(cost, origin, dest)
                    if way is not None:
                        rows = [(g, node[origin], node[dest], 0, node[dest], float(cost[dest]), None)]
                        rows += [(g, node[origin], node[dest], i, node[v], c, int(ids[k])) for i, (v, c, k) in enumerate(way, 1)]
                        for c, v in zip(out, zip(*rows, strict=True), strict=True):
                            c.extend(v)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(out, _PATHS, strict=True)], schema=_PATHS)

    return edges.select("job", "g", "a", "b", "w", "id").groupBy("job").cogroup(asked.select("job", "g", "origin", "dest").groupBy("job")).applyInArrow(search, "g int, origin long, dest long, back long, node long, cost double, edge long")


class Ways:
    """Ways of a task by the places of their ends. A node is 2 * way + the side on which the way is left, ways in order of their ids."""

    def __init__(self, ways: pa.Table, within: float) -> None:
        ids, first = np.unique(ways["id"].to_numpy(), return_index=True)
        self.ids, self.km = ids, ways["w"].to_numpy()[first].tolist()
        ends = np.stack([np.stack([ways[f"{e}_{c}"].to_numpy()[first] for c in ("lng", "lat")], 1) for e in "st"], 1).reshape(-1, 2)
        xy, at = np.unique(ends, axis=0, return_inverse=True)
        self.place = at.ravel().tolist()
        self.ends_at: list[list[int]] = [[] for _ in xy]
        for node, place in enumerate(self.place):
            self.ends_at[place].append(node)
        cells: dict[tuple[int, int], list[int]] = {}
        keys = [tuple(k) for k in np.floor(xy / within).astype(np.int64).tolist()]
        for place, key in enumerate(keys):
            cells.setdefault(key, []).append(place)
        xy = xy.tolist()
        self.near = [[q for dx in (-1, 0, 1) for dy in (-1, 0, 1) for q in cells.get((kx + dx, ky + dy), ()) if math.sqrt((x - xy[q][0]) ** 2 + (y - xy[q][1]) ** 2) < within] for (x, y), (kx, ky) in zip(xy, keys, strict=True)]

    def costs(self, origin: int, dests: set[int]) -> tuple[dict[int, float], dict[int, int]]:
        """Least costs of nodes from a way on, as far as the ways wanted need, and the order in which they were settled.

        Of all that leave a way near a place the first is the cheapest, so what begins there is looked at once; only the first one's own
        way, which it may not enter again, waits for the next.
        """
        done, order, best = {}, {}, {2 * origin: self.km[origin], 2 * origin + 1: self.km[origin]}
        heap, first, closed, left, bound = [(c, n) for n, c in best.items()], {}, set(), set(dests), math.inf
        while heap:
            c, v = heapq.heappop(heap)
            if v in done:
                continue
            if c + 1.0 > bound:
                break
            done[v], order[v], way = c, len(order), v // 2
            left.discard(way)
            if not left and bound == math.inf:
                bound = c + 1.0
            for q in self.near[self.place[v]]:
                if q not in first:
                    first[q] = way
                    on = [e for e in self.ends_at[q] if e // 2 != way]
                elif first[q] != way and q not in closed:
                    closed.add(q)
                    on = [e for e in self.ends_at[q] if e // 2 == first[q]]
                else:
                    continue
                for e in on:
                    u, d = e ^ 1, c + self.km[e // 2]
                    if d < best.get(u, math.inf):
                        best[u] = d
                        heapq.heappush(heap, (d, u))
        return done, order

    def back(self, done: dict[int, float], order: dict[int, int], origin: int, dest: int) -> list[tuple[int, float]]:
        """The nodes of the cheapest path to a way with their costs, from its end; the lesser node where ways are equally cheap."""
        ends = [(done[n] + 1.0, n) for n in (2 * dest, 2 * dest + 1) if n in done]
        if not ends:
            return []
        v = min(ends)[1]
        path = [(v, done[v])]
        while not (v // 2 == origin and done[v] == self.km[origin]):
            way, c = v // 2, done[v]
            before = (n for p in self.near[self.place[v ^ 1]] for n in self.ends_at[p] if n // 2 != way and n in done and done[n] + self.km[way] == c and order[n] < order[v])
            v = min(before)
            path.append((v, done[v]))
        return path


_WAYS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("nr", pa.int32()), ("way", pa.int64()), ("backward", pa.bool_()), ("km", pa.float64())])


def way_paths(ways: DataFrame, asked: DataFrame, within: float) -> DataFrame:
    """Cheapest paths of ways as in stitching.way_paths: a, b, nr, way, backward, km. ways (id, w, s_lng, s_lat, t_lng, t_lat), asked (from, to, ways): as `deal` gives them."""

    def search(ways: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in _WAYS]
        if ways.num_rows and asked.num_rows:
            net = Ways(ways, within)
            ids, wanted = net.ids.tolist(), {}
            for a, b in zip(*(np.searchsorted(net.ids, asked[c].to_numpy()).tolist() for c in ("from", "to")), strict=True):
                wanted.setdefault(a, set()).add(b)
            for a, dests in wanted.items():
                done, order = net.costs(a, dests)
                for b in dests:
                    for nr, (v, c) in enumerate(reversed(net.back(done, order, a, b))):
                        for column, x in zip(out, (ids[a], ids[b], nr, ids[v // 2], v % 2 == 0, c), strict=True):
                            column.append(x)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(out, _WAYS, strict=True)], schema=_WAYS)

    return ways.select("job", "id", "w", "s_lng", "s_lat", "t_lng", "t_lat").groupBy("job").cogroup(asked.select("job", "from", "to").groupBy("job")).applyInArrow(search, "a long, b long, nr int, way long, backward boolean, km double")
