"""Embedding near-duplicates on a robust-pruned flat graph built from overlapping cluster shards.

Equal vectors of a label are one node with a number of copies. The nodes of a label are divided by centroids of a bounded
sample, again and again while a shard has more than LARGE nodes; each node stands in its nearest shards (they overlap),
the nearest of all is its home. In each shard every node gets its nearest nodes and some far ones as candidates, robustly
pruned; the lists of a node from all its shards are united into one flat graph.

The search runs over pairs of home shards: the nodes of each look for those of the other, greedily from the nearest
medoids and their own neighbours there, until the beam holds nothing unvisited, then expanding around everything within
the expansion range. It begins with every shard against itself and against those that a short edge of the united lists
leads to; where it comes to a node with a short edge into a further shard, that pair of shards is searched in the next
round, until no new pair turns up. A pair of nodes thus meets in exactly one task, that of their homes, and what either
side finds counts for both. Hits are confirmed by the cosine in double precision. Pairs never leave the task: it
returns a count for each node and a spanning forest of its links.

The recall is audited by brute force, in blocks, for every vector whose id is divisible by QUERY_EVERY; below RECALL the
work is repeated with a wider search, and, where the widest one still misses too much, by comparing all blocks of a label.

Nulls: vectors that are null, zero, or hold null or non-finite components, and rows without a label, link with nothing.
A row without vec_id stays a row and takes part; its component_id is null, and it is kept, only if it reaches no vec_id.
Vectors of different length never link. Repeated rows are vectors of their own and link with each other. Ties in cosine
change nothing, as every link counts. Extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapsewise.llm.shared import Scratch, components, mix, read_table

LEAST = 0.98
#: Nodes of a shard that a division aims at, and beyond which a shard is divided; nodes that centroids are fitted on.
SHARD, LARGE, SAMPLE = 400, 1000, 4096
#: Parts of one division, at least (more than the shards of a node) and at most; nodes that one task assigns.
FEWEST, MOST, ASSIGN = 16, 64, 5000
NEAR, FAR, DEGREE, ALPHA = 40, 8, 16, 1.2
QUERY_EVERY, RECALL = 50, 0.9
#: Audited vectors that one pass compares with all others; vectors of a block of the exact comparison.
AUDIT, EXACT = 2000, 1000
#: Numbers that one step of the search multiplies, and queries that search at once.
STEP, BLOCK = 4_000_000, 256
KEY = ["label", "bytes", "shard"]


@dataclass(frozen=True)
class Breadth:
    """Shards of a node, beam of the greedy search, cosine down to which the range search expands."""

    overlap: int
    beam: int
    expand: float


#: The second and third are for data on which the audit finds too little.
BREADTHS = (Breadth(3, 8, 0.93), Breadth(5, 16, 0.88), Breadth(8, 32, 0.8))


def usable(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All rows, with unit vectors as bytes where the vector can be compared."""
    for frame in frames:
        units = []
        for label, raw in zip(frame["label"], frame["embedding"], strict=True):
            unit = None
            if raw is not None and label is not None and label == label and not any(x is None for x in raw):
                x = np.asarray(raw, np.float64)
                if x.size and np.isfinite(x).all() and x.any():
                    x = x / np.abs(x).max()
                    unit = (x / np.sqrt(x @ x)).tobytes()
            units.append(unit)
        yield pd.DataFrame({"vec_id": frame["vec_id"], "label": frame["label"], "unit": units})


def matrix(units: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(bytes(u) for u in units), np.float64).reshape(len(units), -1)


def fit_centroids(frame: pd.DataFrame) -> pd.DataFrame:
    """Centroids of one shard: a few rounds of spherical k-means on its sample; none if they do not divide it."""
    frame = frame.sort_values("node")
    x, n = matrix(frame["unit"]), int(frame["n"].iloc[0])
    k = int(min(len(x), MOST, max(FEWEST, np.ceil(2 * n / SHARD))))
    c = x[np.random.default_rng(7).choice(len(x), k, replace=False)]
    for _ in range(5):
        near = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        size = np.sqrt((sums**2).sum(axis=1, keepdims=True))
        c = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), c)
    most = np.bincount((x @ c.T).argmax(axis=1), minlength=k).max()
    return frame[[*KEY, "n"]].head(1).assign(centroids=[c.tobytes() if most <= 0.9 * len(x) else b""])


def assigner(overlap: int):
    """Rows of one shard, each for the overlap nearest centroids. Without centroids: overlapping parts by hash."""

    def run(rows: pd.DataFrame, fitted: pd.DataFrame) -> pd.DataFrame:
        node, x = rows["node"].to_numpy(), matrix(rows["unit"])
        raw = bytes(fitted["centroids"].iloc[0])
        if raw:
            s = x @ np.frombuffer(raw, np.float64).reshape(-1, x.shape[1]).T
            top = np.argsort(-s, axis=1, kind="stable")[:, :overlap]
            sim = np.take_along_axis(s, top, 1)
        else:
            first = (mix(node.view(np.uint64)) % np.uint64(FEWEST)).astype(np.int64)
            top = (first[:, None] + np.arange(overlap)) % FEWEST
            sim = np.ones(top.shape)
        shard = mix(rows["shard"].to_numpy().view(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + top.astype(np.uint64) + np.uint64(1)).view(np.int64)
        out = rows.loc[rows.index.repeat(top.shape[1]), ["node", "label", "bytes", "unit"]]
        return out.assign(shard=shard.ravel(), sim=sim.ravel())

    return run


def deal(nodes: DataFrame, overlap: int, scratch: Scratch) -> DataFrame:
    """node, label, bytes, unit, shards (nearest first) of every node."""
    cells = ["node", "label", "bytes", "unit"]
    placed = nodes.select(*cells, F.array(F.struct(F.lit(1.0).alias("sim"), F.lit(0).cast("long").alias("shard"))).alias("own"))
    placed = scratch.table(placed, "placed")
    while True:
        members = placed.select(*cells, F.explode("own").alias("o")).select(*cells, "o.shard", "o.sim")
        large = scratch.table(members.groupBy(*KEY).agg(F.count("*").alias("n")).where(F.col("n") > LARGE), "large")
        if large.isEmpty():
            return placed.select(*cells, F.transform("own", lambda o: o["shard"]).alias("shards"))
        split = members.join(large, KEY)
        sample = split.where(F.pmod(F.xxhash64("node"), F.lit(1 << 20)) < F.lit(float(SAMPLE << 20)) / F.col("n"))
        fitted = sample.select(*KEY, "n", "node", "unit").groupBy(*KEY).applyInPandas(fit_centroids, "label long, bytes int, shard long, n long, centroids binary")
        fitted = scratch.table(fitted, "centroids")
        parts = F.ceil(F.col("n") / ASSIGN)
        rows = split.withColumn("salt", F.pmod(F.xxhash64("node", F.lit(1)), parts)).drop("n", "sim")
        salted = fitted.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
        split = rows.groupBy(*KEY, "salt").cogroup(salted.groupBy(*KEY, "salt")).applyInPandas(assigner(overlap), "node long, label long, bytes int, unit binary, shard long, sim double")
        both = members.join(large, KEY, "left_anti").select(*cells, "shard", "sim").unionByName(split)
        own = F.slice(F.sort_array(F.collect_list(F.struct("sim", "shard")), False), 1, overlap)
        placed = scratch.table(both.groupBy("node", "label", "bytes").agg(F.first("unit").alias("unit"), own.alias("own")), "placed")


def prune(x: np.ndarray, candidates: np.ndarray, first: int) -> list[np.ndarray]:
    """Robust pruning for the vectors x[first:]: keep the nearest candidate, drop those ALPHA times nearer to it than to the vector, and so on."""
    n, k = candidates.shape
    rows = np.arange(n)
    own, near = first + rows, x[candidates]
    d = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ncd,nd->nc", near, x[own])))
    alive = candidates != own[:, None]
    picks = np.full((n, DEGREE), -1)
    for r in range(min(DEGREE, k)):
        j = np.where(alive, d, np.inf).argmin(axis=1)
        ok = alive[rows, j]
        if not ok.any():
            break
        v = candidates[rows, j]
        picks[ok, r] = v[ok]
        between = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ncd,nd->nc", near, x[v])))
        alive &= ~(ok[:, None] & (ALPHA * between <= d))
        alive[rows, j] = False
        alive &= candidates != v[:, None]
    return [p[p >= 0] for p in picks]


def builder(expand: float):
    """Pruned out-neighbours of every node of one shard, and those of them that are near."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("node")
        ids, x = frame["node"].to_numpy(), matrix(frame["unit"])
        n = len(ids)
        near, lists = min(NEAR, n), []
        spread = np.unique(np.linspace(0, n - 1, min(FAR, n)).astype(int))
        step = max(1, STEP // (x.shape[1] * (NEAR + FAR)))
        for first in range(0, n, step):
            block = x[first : first + step] @ x.T
            top = np.argpartition(-block, near - 1, axis=1)[:, :near]
            lists += prune(x, np.concatenate([top, np.broadcast_to(spread, (len(block), len(spread)))], axis=1), first)
        short = [p[x[p] @ x[i] >= expand] for i, p in enumerate(lists)]
        return pd.DataFrame({"node": ids, "neighbours": [ids[p] for p in lists], "short": [ids[p] for p in short]})

    return run


class Side:
    """The nodes of one home shard with their flat graph, as far as it stays among them."""

    def __init__(self, frame: pd.DataFrame):
        frame = frame.sort_values("node")
        self.ids, self.x, self.copies = frame["node"].to_numpy(), matrix(frame["unit"]), frame["copies"].to_numpy()
        self.lists, self.bridges = [np.asarray(x, np.int64) for x in frame["neighbours"]], [np.asarray(x, np.int64) for x in frame["bridges"]]
        n = len(self.ids)
        at, ok = self.places(self.lists)
        inner = [a[k] for a, k in zip(at, ok, strict=True)]
        widest = max(1, max(map(len, inner)))
        self.out = np.stack([np.concatenate([p, np.full(widest - len(p), i)]) for i, p in enumerate(inner)]).astype(np.int64)
        medoids = [int((self.x @ self.x.mean(axis=0)).argmax())]
        far = self.x @ self.x[medoids[0]]
        for _ in range(int(np.ceil(np.sqrt(n))) - 1):  # the vectors farthest from all medoids so far
            medoids.append(int(far.argmin()))
            far = np.maximum(far, self.x @ self.x[medoids[-1]])
        self.medoids = np.unique(medoids)

    def places(self, lists: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Places of ids among this side's nodes, and whether they are there."""
        at = [np.minimum(np.searchsorted(self.ids, x), len(self.ids) - 1) for x in lists]
        return at, [self.ids[a] == x for a, x in zip(at, lists, strict=True)]


def in_range(q: np.ndarray, start: np.ndarray, x: np.ndarray, out: np.ndarray, breadth: Breadth) -> np.ndarray:
    """Cosines of the queries with the nodes that the search sees (-2: not seen). start: where each query begins.

    out: neighbours of each node, padded with the node itself. A node is expanded once for a query, so a search ends
    after as many rounds as there are nodes at most.
    """
    score, done = np.full(start.shape, -2.0), np.zeros(start.shape, bool)
    step = max(1, STEP // x.shape[1])

    def see(rows: np.ndarray, cols: np.ndarray) -> None:
        for i in range(0, len(rows), step):
            r, c = rows[i : i + step], cols[i : i + step]
            score[r, c] = np.einsum("nd,nd->n", q[r], x[c])

    def expand(rows: np.ndarray, cols: np.ndarray) -> None:
        done[rows, cols] = True
        to = np.zeros(start.shape, bool)
        to[np.repeat(rows, out.shape[1]), out[cols].ravel()] = True
        see(*np.nonzero(to & (score < -1.5)))

    see(*np.nonzero(start))
    live, k = np.arange(len(q)), min(breadth.beam, len(x))
    while len(live):  # greedy: expand what the beam holds unexpanded, as long as there is any
        beam = np.argpartition(-score[live], k - 1, axis=1)[:, :k]
        fresh = ~done[live[:, None], beam] & (score[live[:, None], beam] > -1.5)
        r, j = np.nonzero(fresh)
        expand(live[r], beam[r, j])
        live = live[fresh.any(axis=1)]
    while True:  # then around everything in the expansion range
        r, c = np.nonzero((score >= breadth.expand) & ~done)
        if not len(r):
            return score
        expand(r, c)


def looked_for(a: Side, b: Side, breadth: Breadth) -> tuple[np.ndarray, np.ndarray]:
    """Which nodes of b each node of a links with, and which nodes of b lie in the expansion range of some node of a."""
    hits, reached = np.zeros((len(a.ids), len(b.ids)), bool), np.zeros(len(b.ids), bool)
    at, ok = b.places(a.lists)
    for first in range(0, len(a.ids), BLOCK):
        q = a.x[first : first + BLOCK]
        start = np.zeros((len(q), len(b.ids)), bool)
        best = b.medoids[(q @ b.x[b.medoids].T).argsort(axis=1)[:, -2:]]
        start[np.arange(len(q))[:, None], best] = True
        for i in range(len(q)):
            start[i, at[first + i][ok[first + i]]] = True
            if a is b:
                start[i, first + i] = True
        score = in_range(q, start, b.x, b.out, breadth)
        hits[first : first + BLOCK] = score >= LEAST
        reached |= (score >= breadth.expand).any(axis=0)
    return hits, reached


FOUND = "label long, bytes int, node long, links long, parent long, a long, b long"


def searcher(breadth: Breadth):
    """For one pair of home shards: of each node with links their number here and a parent in the spanning forest; further pairs of shards (node null)."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        first, second = int(frame["a"].iloc[0]), int(frame["b"].iloc[0])
        a = Side(frame[frame["shard"] == first])
        b = a if first == second else Side(frame[frame["shard"] == second])
        hits, in_b = looked_for(a, b, breadth)
        further: set[tuple[int, int]] = set()
        if a is b:
            hits |= hits.T
            np.fill_diagonal(hits, False)
            ids, links = a.ids, hits @ a.copies
        else:
            back, in_a = looked_for(b, a, breadth)
            hits |= back.T
            ids, links = np.concatenate([a.ids, b.ids]), np.concatenate([hits @ b.copies, hits.T @ a.copies])
            for own, other, reached in ((first, b, in_b), (second, a, in_a)):
                ends = {int(s) for i in np.flatnonzero(reached) for s in other.bridges[i]} - {first, second}
                further |= {(min(own, s), max(own, s)) for s in ends}
        u, v = np.nonzero(hits)
        v = v if a is b else v + len(a.ids)
        parent = np.arange(len(ids))
        while len(u):  # smallest reachable row, by propagation and shortcuts
            new = parent.copy()
            np.minimum.at(new, u, parent[v])
            np.minimum.at(new, v, parent[u])
            new = new[new]
            if (new == parent).all():
                break
            parent = new
        some = np.flatnonzero(links > 0)
        more = sorted(further)
        none = [None] * len(more)
        return pd.DataFrame(
            {
                "label": frame["label"].iloc[0],
                "bytes": frame["bytes"].iloc[0],
                "node": pd.array([*ids[some].tolist(), *none], "Int64"),
                "links": pd.array([*links[some].astype(np.int64).tolist(), *none], "Int64"),
                "parent": pd.array([*ids[parent[some]].tolist(), *none], "Int64"),
                "a": pd.array([None] * len(some) + [p for p, _ in more], "Int64"),
                "b": pd.array([None] * len(some) + [p for _, p in more], "Int64"),
            }
        )

    return run


def links_of(nodes: DataFrame, breadth: Breadth, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """nodes (node, label, bytes, unit, copies): (node, links) of nodes with links to others, weighted by copies; (node, component)."""
    dealt = scratch.table(deal(nodes, breadth.overlap, scratch), "dealt")
    shards = dealt.select("node", "label", "bytes", "unit", F.explode("shards").alias("shard"))
    lists = shards.groupBy(*KEY).applyInPandas(builder(breadth.expand), "node long, neighbours array<long>, short array<long>")
    united = lambda c: F.array_distinct(F.flatten(F.collect_list(c))).alias(c)
    lists = scratch.table(lists.groupBy("node").agg(united("neighbours"), united("short")), "lists")
    home = dealt.select("node", F.get("shards", 0).alias("home"))
    bridges = lists.select(F.col("node").alias("from"), F.explode("short").alias("node")).join(home, "node").groupBy(F.col("from").alias("node")).agg(F.collect_set("home").alias("bridges"))
    graph = dealt.select("node", "label", "bytes", "unit", F.get("shards", 0).alias("shard")).join(nodes.select("node", "copies"), "node").join(lists.select("node", "neighbours"), "node").join(bridges, "node", "left")
    graph = scratch.table(graph.withColumn("bridges", F.coalesce(F.array_remove("bridges", F.col("shard")), F.array().cast("array<long>"))), "graph")
    # every home shard against itself, and against those that its short edges lead to
    apart = graph.select("label", "bytes", "shard", F.explode("bridges").alias("to")).select("label", "bytes", F.least("shard", "to").alias("a"), F.greatest("shard", "to").alias("b"))
    todo = scratch.table(graph.select("label", "bytes", F.col("shard").alias("a"), F.col("shard").alias("b")).unionByName(apart).distinct(), "pairs")
    done, found = todo, None
    while True:
        sides = todo.withColumn("shard", F.explode(F.array_distinct(F.array("a", "b"))))
        new = graph.join(sides, KEY).groupBy("label", "bytes", "a", "b").applyInPandas(searcher(breadth), FOUND)
        new = scratch.table(new, "found")
        found = new if found is None else found.unionByName(new)
        todo = new.where("node is null").select("label", "bytes", "a", "b").distinct().join(done, ["label", "bytes", "a", "b"], "left_anti")
        todo = scratch.table(todo, "pairs")
        if todo.isEmpty():
            break
        done = done.unionByName(todo)
    found = found.where("node is not null")
    tree = components(found.where("node <> parent").select(F.col("node").alias("a"), F.col("parent").alias("b")), scratch)
    return scratch.table(found.groupBy("node").agg(F.sum("links").alias("links")), "links"), scratch.table(tree, "components")


def recall(keyed: DataFrame, links: DataFrame, classes: DataFrame) -> float:
    """Links found of links there, by brute force against all nodes, of every vector whose id is divisible by QUERY_EVERY; 1 where there are none."""
    asked = keyed.where(F.col("unit").isNotNull() & (F.pmod("vec_id", F.lit(QUERY_EVERY)) == 0))
    asked = asked.join(classes.select("label", "h1", "h2", "node"), ["label", "h1", "h2"]).join(links, "node", "left")
    asked = asked.select("node", "label", "bytes", "unit", F.coalesce("links", F.lit(0)).alias("links"))

    def there(own: pd.DataFrame) -> int:
        groups = {key: (matrix(part["unit"]), part["node"].to_numpy()) for key, part in own.groupby(["label", "bytes"])}

        def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                n = 0
                for key, part in frame.groupby(["label", "bytes"]):
                    if key in groups:
                        q, ids = groups[key]
                        hit = (q @ matrix(part["unit"]).T >= LEAST) & (ids[:, None] != part["node"].to_numpy())
                        n += int((hit @ part["copies"].to_numpy()).sum())
                yield pd.DataFrame({"n": [n]})

        return classes.select("node", "label", "bytes", "unit", "copies").mapInPandas(count, "n long").agg(F.sum("n")).first()[0] or 0

    found, all_, rows = 0, 0, []
    for r in asked.toLocalIterator():  # a block at a time on the driver
        found += r["links"]
        rows.append(r.asDict())
        if len(rows) == AUDIT:
            all_, rows = all_ + there(pd.DataFrame(rows)), []
    if rows:
        all_ += there(pd.DataFrame(rows))
    return found / all_ if all_ else 1.0


def linked_in_blocks(frame: pd.DataFrame) -> pd.DataFrame:
    """Links of the nodes of two blocks with each other (or of one with itself), and the least node of each linked group."""
    x, ids, copies, block = matrix(frame["unit"]), frame["node"].to_numpy(), frame["copies"].to_numpy(), frame["block"].to_numpy()
    hit = x @ x.T >= LEAST
    np.fill_diagonal(hit, False)
    if frame["lo"].iloc[0] != frame["hi"].iloc[0]:
        hit &= block[:, None] != block
    group = np.argsort(np.argsort(ids))
    while True:
        new = np.minimum(group, np.where(hit, group, len(ids)).min(axis=1))
        if (new == group).all():
            break
        group = new
    some = np.flatnonzero(hit.any(axis=1))
    return pd.DataFrame({"node": ids[some], "links": (hit[some] @ copies).astype(np.int64), "parent": np.sort(ids)[group[some]]})


def exact_links(nodes: DataFrame, scratch: Scratch, size: int = EXACT) -> tuple[DataFrame, DataFrame]:
    """What links_of gives, by comparing every two blocks of a label: for data on which the graph finds too little."""
    per = nodes.groupBy("label", "bytes").agg(F.ceil(F.count("*") / F.lit(size)).alias("blocks"))
    dealt = nodes.join(per, ["label", "bytes"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    pairs = dealt.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other")).drop("blocks", "other")
    found = scratch.table(pairs.groupBy("label", "bytes", "lo", "hi").applyInPandas(linked_in_blocks, "node long, links long, parent long"), "exact")
    tree = components(found.where("node <> parent").select(F.col("node").alias("a"), F.col("parent").alias("b")), scratch)
    return scratch.table(found.groupBy("node").agg(F.sum("links").alias("links")), "links"), scratch.table(tree, "components")


def near_vectors(vectors: DataFrame, scratch: Scratch | None = None, breadths: tuple[Breadth, ...] = BREADTHS) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    scratch = scratch or Scratch(vectors.sparkSession, "vectors")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("long").alias("label"))
    units = rows.mapInPandas(usable, "vec_id long, label long, unit binary")
    keyed = scratch.table(units.select("vec_id", "label", "unit", F.length("unit").alias("bytes"), F.xxhash64("unit").alias("h1"), F.xxhash64(F.lit(1), "unit").alias("h2")), "units")
    classes = keyed.where("unit is not null").groupBy("label", "bytes", "h1", "h2").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("unit").alias("unit"))
    classes = scratch.table(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    for breadth in breadths:
        links, tree = links_of(classes.select("node", "label", "bytes", "unit", "copies"), breadth, scratch)
        if recall(keyed, links, classes) >= RECALL:
            break
    else:
        links, tree = exact_links(classes.select("node", "label", "bytes", "unit", "copies"), scratch)
    of = classes.select("label", "h1", "h2", "least", "copies", "node").join(links, "node", "left").join(tree, "node", "left")
    of = scratch.table(of.select("label", "h1", "h2", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component")), "per-class")
    least = scratch.table(of.groupBy("component").agg(F.min("least").alias("component_id")), "least")
    of = scratch.table(of.join(least, "component").drop("component", "least"), "of-class")
    # rows without a class get a key of their own, so that they do not meet in one task
    own = keyed.select("vec_id", F.when(F.col("unit").isNotNull(), F.col("label")).alias("l"), F.when(F.col("unit").isNotNull(), F.col("h1")).otherwise(F.xxhash64("vec_id")).alias("x"), F.col("h2").alias("y"))
    out = own.join(of, (F.col("l") == F.col("label")) & (F.col("x") == F.col("h1")) & (F.col("y") == F.col("h2")), "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def audit_recall(vectors: DataFrame, result: DataFrame, block: int = 2000) -> tuple[int, int]:
    """Links found and links there of every vector whose id is divisible by QUERY_EVERY, by brute force against all rows."""
    units = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("long").alias("label"))
    units = units.mapInPandas(usable, "vec_id long, label long, unit binary").where("unit is not null and vec_id is not null")
    asked = units.where(F.col("vec_id") % QUERY_EVERY == 0)
    truth = 0
    rows: list = []

    def count(rows: list) -> int:
        ids, labels = np.array([r["vec_id"] for r in rows]), np.array([r["label"] for r in rows])
        q = matrix(pd.Series([r["unit"] for r in rows]))

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                if len(frame):
                    hit = (q @ matrix(frame["unit"]).T >= LEAST) & (labels[:, None] == frame["label"].to_numpy()) & (ids[:, None] != frame["vec_id"].to_numpy())
                    yield pd.DataFrame({"n": [int(hit.sum())]})

        return units.mapInPandas(run, "n long").agg(F.sum("n")).first()[0] or 0

    for r in asked.toLocalIterator():
        rows.append(r)
        if len(rows) == block:
            truth, rows = truth + count(rows), []
    if rows:
        truth += count(rows)
    return result.where(F.col("vec_id") % QUERY_EVERY == 0).agg(F.sum("n_links")).first()[0] or 0, truth


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read_table(spark, sf_dir, "embeddings"))


#: Cosines of all pairs of a label, then reachability, for the small tables of the SQL check.
SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
       AND list_sum(list_transform(e, lambda x: x * x)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
          WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
top AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN top USING (vec_id) LEFT JOIN n USING (vec_id)
"""
