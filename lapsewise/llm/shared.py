"""What several corpus operators share: written intermediate tables, connected components, fast text hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step works on.
STEP_BYTES = 2_000_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Intermediate tables in the folder that the cluster shares (spark.checkpoint.dir).

    A written table cuts the lineage and survives the loss of an executor. Only on one machine, as in tests, a temporary
    folder stands in where the setting is missing.
    """

    #: Those made inside the collecting() of this thread of work, if it is in one.
    opened: ContextVar[list[Scratch] | None] = ContextVar("opened", default=None)

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="lapsewise-")
        self.base = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.made = 0
        if (own := Scratch.opened.get()) is not None:
            own.append(self)

    def delete(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    @staticmethod
    @contextmanager
    def collecting() -> Iterator[None]:
        """Delete, at the end, the tables of every Scratch that was made inside, and of no other: for a caller that has written what was derived from them."""
        made: list[Scratch] = []
        token = Scratch.opened.set(made)
        try:
            yield
        finally:
            Scratch.opened.reset(token)
            for scratch in made:
                scratch.delete(scratch.base)

    def table(self, df: DataFrame, name: str, slim: bool = False) -> DataFrame:
        """df written and read again; slim: its rows are few against the corpus, so an eighth of the tasks will do."""
        self.made += 1
        if slim:
            df = df.coalesce(max(self.spark.sparkContext.defaultParallelism, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // 8))
        path = f"{self.base}/{self.made:03d}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later step reads."""
        for df in tables:
            self.delete(df._scratch_path)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of value, which is worked out once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def scan(x: Column, zero: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Running totals (inclusive) of an array of long, in chunks of about the root of its size, so that no long array is copied per element."""
    none = F.array().cast("array<bigint>")
    last = lambda a: F.coalesce(F.get(a, F.size(a) - 1), zero)
    size = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(x)))).cast("int")
    chunks = F.when(F.size(x) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / size).cast("int")), lambda c: F.slice(x, c * size + 1, size))).otherwise(F.array().cast("array<array<bigint>>"))
    inside = F.transform(chunks, lambda c: F.aggregate(c, none, lambda acc, v: F.concat(acc, F.array(combine(last(acc), v)))))

    def joined(parts: Column) -> Column:
        before = F.aggregate(parts, F.array(zero), lambda acc, c: F.concat(acc, F.array(combine(last(acc), last(c)))))
        return let(before, lambda b: F.flatten(F.transform(parts, lambda c, i: F.transform(c, lambda v: combine(F.get(b, i), v)))))

    return let(inside, joined)


def running_sums(x: Column) -> Column:
    return let(x, lambda a: scan(a, F.lit(0).cast("long"), lambda p, q: p + q))


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of every node in links (a, b): component is the smallest node reachable.

    Alternating large-star and small-star contraction: the number of rounds grows with the logarithm of the longest
    path. The minima are written before they are joined, so that both sides of each join are plain shuffles and a
    node with very many neighbours can be split by adaptive execution.
    """

    def minima(edges: DataFrame, name: str) -> DataFrame:
        return scratch.table(edges.groupBy("u").agg(F.min("v").alias("m")), name, slim=True)

    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = scratch.table(edges, "edges", slim=True)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = minima(both, "large-min").withColumn("m", F.least("m", "u"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.table(large.where("u <> v").distinct(), "large", slim=True)
        joined = large.join(minima(large, "small-min"), "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = small.unionByName(joined.select("u", F.col("m").alias("v"))).where("u > v").distinct()
        new = scratch.table(new, "edges", slim=True)
        scratch.drop(edges)
        edges = new
        if edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            break  # every parent is a root
    tops = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops)


def blocks(frames: Iterator[pd.DataFrame], column: str = "text", limit: int = STEP_BYTES) -> Iterator[pd.DataFrame]:
    """The same rows in blocks of about limit characters, so that memory follows the block and not the batch."""
    for frame in frames:
        if not len(frame):
            continue
        total = frame[column].fillna("").str.len().to_numpy(dtype=np.int64).cumsum()
        first = 0
        while first < len(frame):
            before = total[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(total, before + limit, "right")))
            yield frame.iloc[first:last]
            first = last


# ---- hashing of words and spans of a byte buffer, vectorised ----------------------------------------------------

_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * np.uint64(pow(base, done, 2**64))
        done += step
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class SpanHash:
    """Hash of any span of a byte buffer in constant time, from prefix sums of a polynomial modulo 2**64."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.prefix = np.empty(n + 1, np.uint64)
        self.prefix[0] = 0
        np.cumsum(_BYTE[data] * powers(_BASE, max(1, n))[:n], out=self.prefix[1:])
        self.back = powers(_INVERSE, n + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.prefix[end] - self.prefix[start]) * self.back[start] + (end - start).astype(np.uint64))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def block_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each span of a byte buffer, eight bytes at a time through the finaliser.

    A span of up to eight bytes is told apart from any other of its length for certain. Every block goes through the
    finaliser before the next is added, so that no pattern of a text cancels out, as it can in a sum of powers.
    """
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    at_byte = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place on
    size = end - start
    out = mix(size.astype(np.uint64) * np.uint64(_BASE))
    open_ = np.arange(len(start))
    done = 0
    while len(open_):
        left = size[open_] - done
        block = at_byte[start[open_] + done].astype(np.uint64)
        short = left < 8
        block[short] &= (np.uint64(1) << (left[short].astype(np.uint64) * np.uint64(8))) - np.uint64(1)
        out[open_] = mix(out[open_] * np.uint64(3) + mix(block + np.uint64(done + 1)))
        done += 8
        open_ = open_[left > 8]
    return out


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased (A-Z) words of all texts in order, and the number of words of each text."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = _SPACE[raw]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[0::2], edge[1::2]
    start = start[: len(end)]
    bounds = np.cumsum([len(t) + 1 for t in texts])
    per = np.diff(np.searchsorted(start, np.concatenate([[0], bounds])))
    return block_hashes(_LOWER[raw], start, end), per


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word shingles of each text; a shorter text is one shingle of all its words."""
    words, per = word_hashes(texts)
    out, at = [], 0
    for n in per:
        own = words[at : at + n]
        at += n
        if n == 0:
            out.append(np.empty(0, np.uint64))
            continue
        k = min(n, width)
        acc = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            acc = mix(acc * np.uint64(_BASE) + own[j : j + n - k + 1] + np.uint64(j + 1))
        out.append(np.unique(acc))
    return out


def encoded(texts: pd.Series) -> list[bytes]:
    return [b"" if t is None or t != t else t.encode("utf-8", "surrogatepass") for t in texts]
