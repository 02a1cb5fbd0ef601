"""MinHash near-duplicates with sequential Bayesian verification.

Signatures of 128 minima are cut into 32 bands of 4 (a pair at Jaccard 0.75 misses every band with probability 5e-6).
Candidates that share a band are compared in batches of 64 of 1024 further one-byte minima; after each batch the posterior
probability that the similarity reaches the threshold is bounded, and a pair is pruned when it falls under the chosen
miss probability. Survivors are confirmed on their full shingle sets.

Pairs are never written per band. First every document is compared with the first document of each of its bands. Then
only bands that still hold several components are searched. In each, the documents outside its largest component are
compared with all of its documents, within tasks of bounded size: a large band is a grid of blocks, to which rows are
dealt, so that every pair of its documents across components meets in one cell. A cell first returns its documents with a
surviving partner, at most its own rows; these get their full sets, and the cell confirms the survivors that are still
apart, one document against batches of others, and returns a spanning forest of the links. Nothing that is written grows
with the pairs of a group.

Nulls: a null or wordless text has no shingles and is linked with nothing. A null doc_id is a row of its own; its
component_id is the smallest doc_id it reaches, null if it reaches none, and it is then kept. Rows with one doc_id and
different texts are separate documents that share their doc_id; repeated rows get the same result. Identical sets count
as one document. Ties change nothing, as a component is all that links reach. Extra columns of the input are ignored. An
empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapsewise.llm.shared import Scratch, blocks, components, encoded, mix, read_table, shingle_sets

WIDTH, NUMERATOR, DENOMINATOR = 5, 75, 100
BANDS, ROWS = 32, 4
#: Further minima of the candidates, compared one byte each, a batch at a time.
PARTS, BATCH = 1024, 64
#: A pair is pruned when the posterior probability of reaching the threshold is below this.
MISS = 1e-5
#: Documents of a cell, on the side that asks and on the side that is asked; shingles of either side; on average.
ASKING, ASKED, SHINGLES = 1024, 2048, 4_000_000
#: Partners of one document that are verified in one group, and rows of cells that one call searches, on average.
GROUP, DEAL = 128, 2000

_RNG = np.random.default_rng(42)
_A = _RNG.integers(0, 2**31, BANDS * ROWS + PARTS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _RNG.integers(0, 2**32, BANDS * ROWS + PARTS, dtype=np.uint32)


def signatures(sets: list[np.ndarray], which: range) -> np.ndarray:
    """Minima of the hashes of that range for each non-empty set."""
    sizes = np.array([len(s) for s in sets])
    x = np.concatenate(sets)
    x = (x >> np.uint64(32)).astype(np.uint32) ^ x.astype(np.uint32)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    out = np.empty((len(sets), len(which)), np.uint32)
    for i, k in enumerate(which):
        h = x * _A[k]
        h += _B[k]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        out[:, i] = np.minimum.reduceat(h, starts)
    return out


def describe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per row: size of its shingle set, node (64-bit hash of the set, null if empty), band keys."""
    for frame in blocks(frames):
        sets = shingle_sets(encoded(frame["text"]), WIDTH)
        size = np.array([len(s) for s in sets], np.int64)
        full = np.flatnonzero(size)
        bands, node = [None] * len(frame), [None] * len(frame)
        if len(full):
            sig = signatures([sets[i] for i in full], range(BANDS * ROWS))
            keys = np.zeros((len(full), BANDS), np.uint64)
            keys += np.arange(1, BANDS + 1, dtype=np.uint64)
            for r in range(ROWS):
                keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + sig[:, r::ROWS])
            keys = keys.view(np.int64)
            for j, i in enumerate(full):
                bands[i] = keys[j]
                one, two = mix(sets[i]).sum(dtype=np.uint64), mix(sets[i] + np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64)
                node[i] = int(mix(np.array([one ^ mix(np.array([two]))[0]]))[0].view(np.int64))
        yield pd.DataFrame({"doc_id": frame["doc_id"], "rid": frame["rid"].to_numpy(), "n_shingles": size, "node": pd.array(node, "Int64"), "bands": bands})


def describe_candidates(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One byte of each further minimum, of documents with shingles."""
    for frame in blocks(frames):
        sig = signatures(shingle_sets(encoded(frame["text"]), WIDTH), range(BANDS * ROWS, BANDS * ROWS + PARTS))
        yield pd.DataFrame({"node": frame["node"].to_numpy(), "parts": [x.tobytes() for x in sig.astype(np.uint8)]})


@lru_cache
def least_matches() -> dict[int, int]:
    """For n compared parts, the fewest equal ones at which P(similarity >= threshold) still reaches MISS.

    Uniform prior on the similarity; two parts of one byte also agree by chance, so a pair at similarity s agrees
    with probability s + (1 - s) / 256.
    """
    grid = (np.arange(20000) + 0.5) / 20000
    agree = grid + (1 - grid) / 256
    hit, miss, similar = np.log(agree), np.log1p(-agree), grid >= NUMERATOR / DENOMINATOR

    def enough(m: int, n: int) -> bool:
        logs = m * hit + (n - m) * miss
        mass = np.exp(logs - logs.max())
        return bool(mass[similar].sum() >= MISS * mass.sum())

    # the posterior grows with the number of equal parts
    return {n: bisect_left(range(n + 1), True, key=lambda m: enough(m, n)) for n in range(BATCH, PARTS + 1, BATCH)}


def surviving(parts: np.ndarray, a: np.ndarray, b: np.ndarray, least: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs (a, b) that no batch prunes, and their equal parts."""
    alive = np.arange(len(a))
    equal = np.zeros(len(a), np.int16)
    for n, m in least.items():
        cut = slice(n - BATCH, n)
        equal = equal + (parts[a[alive], cut] == parts[b[alive], cut]).sum(axis=1, dtype=np.int16)
        keep = equal >= m
        alive, equal = alive[keep], equal[keep]
    return alive, equal


def as_matrix(parts: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(parts), np.uint8).reshape(len(parts), PARTS)


def prune_pairs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (a, b, size, parts_a, parts_b) that survive the sequential comparison."""
    least = least_matches()
    for frame in frames:
        if len(frame):
            both = np.concatenate([as_matrix(frame["parts_a"]), as_matrix(frame["parts_b"])])
            n = len(frame)
            alive, _ = surviving(both, np.arange(n), np.arange(n, 2 * n), least)
            yield frame.iloc[alive][["a", "b", "size"]]


class Cell:
    """Rows of one cell: places of those that ask and of those that are asked, and their pairs across components that no batch prunes."""

    def __init__(self, frame: pd.DataFrame):
        self.node, self.label = frame["node"].to_numpy(), frame["component"].to_numpy()
        self.parts = as_matrix(frame["parts"])
        outer = frame["outer"].to_numpy()
        self.asking = np.flatnonzero(outer & (frame["row"] == frame["i"]).to_numpy())
        asked = (frame["column"] == frame["j"]).to_numpy()
        self.inner, self.others = np.flatnonzero(asked & ~outer), np.flatnonzero(asked & outer)

    def survivors(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of a few asking documents at a time: pairs and their equal parts. Of two documents that both ask, the smaller node does."""
        least = least_matches()
        asked = np.concatenate([self.inner, self.others])
        step = max(1, 200_000 // max(1, len(asked)))
        for first in range(0, len(self.asking), step):
            q = self.asking[first : first + step]
            open_ = self.label[q, None] != self.label[asked]
            open_[:, len(self.inner) :] &= self.node[q, None] < self.node[self.others]
            i, j = np.nonzero(open_)
            a, b = q[i], asked[j]
            alive, equal = surviving(self.parts, a, b, least)
            yield a[alive], b[alive], equal


def cells(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
    for _, own in frame.groupby(["key", "i", "j"], sort=False):
        yield own.reset_index(drop=True)


CELL = ["key", "i", "j", "row", "column", "outer", "node", "component"]


def with_partners(frame: pd.DataFrame) -> pd.DataFrame:
    """The rows of some cells that have a surviving partner in their cell."""
    out = []
    for own in cells(frame):
        hit = np.zeros(len(own), bool)
        for a, b, _ in Cell(own).survivors():
            hit[a] = hit[b] = True
        out.append(own.loc[hit, CELL])
    return pd.concat(out)


def confirm_cells(frame: pd.DataFrame) -> pd.DataFrame:
    """Links (a, b) that join components of some cells, confirmed on the full sets: a spanning forest of each cell."""
    links: list[tuple[int, int]] = []
    for own in cells(frame):
        cell = Cell(own)
        sets = shingle_sets(encoded(own["text"]), WIDTH)
        size = np.array([len(x) for x in sets])
        codes = np.split(np.unique(np.concatenate(sets), return_inverse=True)[1], np.cumsum(size)[:-1])
        mark = np.zeros(1 + max(int(c.max()) for c in codes), bool)
        root = {int(x): int(x) for x in cell.label}

        def top(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        for a, b, equal in cell.survivors():
            order = np.lexsort((cell.node[b], -equal, a))
            a, b = a[order], b[order]
            bounds = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1], [True]])) if len(a) else []
            for first, last in zip(bounds, bounds[1:], strict=False):
                q, rest, step = int(a[first]), b[first:last], 1
                mark[codes[q]] = True
                while len(rest):  # the likeliest first; those that have got into the same component meanwhile drop out
                    mine = top(int(cell.label[q]))
                    rest = rest[[top(int(x)) != mine for x in cell.label[rest]]]
                    some, rest = rest[:step], rest[step:]
                    if not len(some):
                        break
                    inter = np.add.reduceat(mark[np.concatenate([codes[i] for i in some])], np.concatenate([[0], np.cumsum(size[some])[:-1]]), dtype=np.int64)
                    for i in some[DENOMINATOR * inter >= NUMERATOR * (size[q] + size[some] - inter)]:
                        links.append((int(cell.node[q]), int(cell.node[i])))
                        root[top(int(cell.label[i]))] = top(int(cell.label[q]))
                    step *= 4
                mark[codes[q]] = False
    return pd.DataFrame(links, columns=["a", "b"], dtype=np.int64)


def confirm(frame: pd.DataFrame) -> pd.DataFrame:
    """One lead document (is_lead) and some partners: the partners whose full set meets the threshold."""
    sets = shingle_sets(encoded(frame["text"]), WIDTH)
    lead = int(np.flatnonzero(frame["is_lead"].to_numpy())[0])
    own, ids = sets[lead], frame["node"].to_numpy()
    linked = []
    for i, other in enumerate(sets):
        if i != lead:
            inter = len(np.intersect1d(own, other, assume_unique=True))
            if DENOMINATOR * inter >= NUMERATOR * (len(own) + len(other) - inter):
                linked.append(ids[i])
    return pd.DataFrame({"a": np.full(len(linked), ids[lead], np.int64), "b": np.array(linked, np.int64)})


def verified(pairs: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """The pairs (a, b, size: shingles of b) whose shingle sets meet the threshold. A document in many or long pairs is dealt out in groups."""
    per = pairs.groupBy("a").agg(F.greatest(F.ceil(F.count("*") / GROUP), F.ceil(F.sum("size") / SHINGLES)).alias("groups"))
    per = scratch.table(per, "per-lead", slim=True)
    dealt = pairs.join(per, "a").select("a", "b", F.pmod(F.xxhash64("b"), "groups").alias("part"))
    leads = dealt.select("a", "part", F.col("a").alias("node"), F.lit(True).alias("is_lead")).distinct()
    needs = leads.unionByName(dealt.select("a", "part", F.col("b").alias("node"), F.lit(False).alias("is_lead")))
    needs = scratch.table(needs, "needs", slim=True)
    return needs.join(texts, "node").groupBy("a", "part").applyInPandas(confirm, "a long, b long")


def near_duplicates(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "minhash")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("rid", F.xxhash64("doc_id", "text"))
    described = docs.mapInPandas(describe, "doc_id long, rid long, n_shingles long, node long, bands array<long>")
    described = scratch.table(described, "described")
    # one row (rid) gives the text of all rows with the same set
    classes = described.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.first("n_shingles").alias("size"), F.min("rid").alias("rid"), F.first("bands").alias("bands"))
    classes = scratch.table(classes, "classes")

    keys = classes.select("node", "size", F.explode("bands").alias("key"))
    shared = scratch.table(keys.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("lead")).where("n > 1").drop("n"), "bands")
    members = scratch.table(keys.join(shared, "key"), "members")
    wanted = scratch.table(members.select("node").distinct().join(classes.select("node", "rid"), "node"), "candidates", slim=True)
    # by shuffle at every size: the wanted rows grow with the corpus
    texts = docs.select("rid", "text").hint("merge").join(wanted, "rid").dropDuplicates(["rid"]).select("node", "text")
    texts = scratch.table(texts, "texts")
    parts = scratch.table(texts.mapInPandas(describe_candidates, "node long, parts binary"), "parts")

    star = members.where("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b"), "size").distinct()
    star = scratch.table(star, "star", slim=True)
    sides = star.join(parts.select(F.col("node").alias("b"), F.col("parts").alias("parts_b")), "b").join(parts.select(F.col("node").alias("a"), F.col("parts").alias("parts_a")), "a")
    tested = scratch.table(sides.select("a", "b", "size", "parts_a", "parts_b").mapInPandas(prune_pairs, "a long, b long, size long"), "tested")
    links = scratch.table(verified(tested, texts, scratch), "links")
    found = scratch.table(components(links, scratch), "components", slim=True)
    more = scratch.table(links_across(members, parts, texts, found, scratch), "more-links")
    if not more.isEmpty():
        found = scratch.table(components(links.unionByName(more), scratch), "components", slim=True)
    scratch.drop(members, texts, parts)

    of_node = scratch.table(classes.select("node", "least").join(found, "node", "left").withColumn("component", F.coalesce("component", "node")), "of-node", slim=True)
    least = scratch.table(of_node.groupBy("component").agg(F.min("least").alias("component_id")), "least", slim=True)
    of_node = of_node.join(least, "component").select(F.col("node").alias("of"), "component_id")
    # rows without shingles get a key of their own, so that they do not meet in one task
    rows = described.select("doc_id", "n_shingles", F.coalesce("node", "rid").alias("of")).join(of_node, "of", "left")
    rows = rows.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return rows.withColumn("kept", F.col("component_id").eqNullSafe(F.col("doc_id")))


def links_across(members: DataFrame, parts: DataFrame, texts: DataFrame, found: DataFrame, scratch: Scratch) -> DataFrame:
    """Links between components from bands that hold several; (a, b) of a spanning forest of each cell."""
    labelled = members.select("key", "node", "size").join(found, "node", "left")
    labelled = scratch.table(labelled.select("key", "node", "size", F.coalesce("component", "node").alias("component")), "labelled")
    per = labelled.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("who")).where("lo <> hi")
    # of bands with the same members only one
    per = scratch.table(per.groupBy("who", "n").agg(F.min("key").alias("key"), F.first("shingles").alias("shingles")).select("key", "n", "shingles"), "open", slim=True)
    rows = scratch.table(labelled.join(per, "key"), "open-rows", slim=True)
    sizes = rows.groupBy("key", "component").agg(F.count("*").alias("k"), F.sum("size").alias("own"), F.first("n").alias("n"), F.first("shingles").alias("shingles"))
    big = sizes.groupBy("key").agg(F.max(F.struct("k", "component", "own")).alias("big"), F.first("n").alias("n"), F.first("shingles").alias("shingles"))
    blocks_of = lambda n, shingles, most: F.greatest(F.lit(1), F.ceil(n / most), F.ceil(shingles / SHINGLES)).cast("int")
    grid = big.select("key", F.col("big.component").alias("largest"), blocks_of(F.col("n") - F.col("big.k"), F.col("shingles") - F.col("big.own"), ASKING).alias("rows"), blocks_of(F.col("n"), F.col("shingles"), ASKED).alias("columns"))
    rows = rows.select("key", "node", "component").join(scratch.table(grid, "grid", slim=True), "key")
    rows = rows.withColumn("outer", F.col("component") != F.col("largest"))
    rows = rows.withColumn("row", F.when(F.col("outer"), F.pmod(F.xxhash64("node", F.lit(1)), F.col("rows"))).otherwise(-1).cast("int")).withColumn("column", F.pmod(F.xxhash64("node", F.lit(2)), F.col("columns")).cast("int"))
    asked = F.transform(F.sequence(F.lit(0), F.col("rows") - 1), lambda i: F.struct(i.alias("i"), F.col("column").alias("j")))
    asking = F.transform(F.sequence(F.lit(0), F.col("columns") - 1), lambda j: F.struct(F.col("row").alias("i"), j.alias("j")))
    rows = rows.withColumn("at", F.explode(F.array_distinct(F.when(F.col("outer"), F.concat(asked, asking)).otherwise(asked))))
    rows = scratch.table(rows.select("key", "at.i", "at.j", "row", "column", "outer", "node", "component"), "cells", slim=True)
    deal = F.pmod(F.xxhash64("key", "i", "j"), F.lit(1 + rows.count() // DEAL))
    schema = "key long, i int, j int, row int, column int, outer boolean, node long, component long"
    left = rows.join(parts, "node").withColumn("deal", deal).groupBy("deal").applyInPandas(with_partners, schema)
    left = scratch.table(left, "undecided")
    deal = F.pmod(F.xxhash64("key", "i", "j"), F.lit(1 + left.count() // (DEAL // 4)))
    return left.join(parts, "node").join(texts, "node").withColumn("deal", deal).groupBy("deal").applyInPandas(confirm_cells, "a long, b long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


#: Exact Jaccard similarity on shingle strings, then reachability, for the small tables of the SQL check.
SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id),
links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM words UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT w.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, c.component_id, c.component_id = w.doc_id AS kept
FROM words w LEFT JOIN sizes s USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)
"""
