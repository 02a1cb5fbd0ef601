"""Removal of lines that many documents share, over levelled sorted runs of line hashes.

A line's key is the line without white space at its ends and with A-Z lowered; a key goes when LEAST_DOCS documents or
more have it. What is known of keys is kept in runs: tables of (key hash, documents), bucketed and sorted by hash, so
that runs meet each other and a new batch in merge joins that shuffle nothing but the batch's own counts. A batch is
counted, merge-anti-joins the runs of keys that are settled (known to go) and adds what is left as its own run. Two runs
of a level are compacted into one run of the next: counts are summed, and keys that reach the bound move to the settled
runs, which are levelled in the same way. So a hash is rewritten once for each level, of which there are as many as
batches have binary digits, and nothing is counted again.

A key is the first 16 bytes of the SHA-256 of its UTF-8 bytes. Documents are rows: rows with equal doc_id, and repeated
rows, count one each; inside, a row goes by a hash of doc_id and text, so that repeated rows share their decisions, which
are equal anyway. Ties need no rule, as all lines of a key share one fate. Nulls: a null or empty text is one empty
line, which has no key; a null doc_id stays a row. Extra columns are carried unchanged in row, whatever their names.
Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import string
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapsewise.llm.shared import Scratch, blocks, read_table

#: White space that a key loses at its ends.
BLANK = b" \t\n\x0b\x0c\r"
LEAST_CHARS, LEAST_DOCS = 1, 10
#: Bytes of a hash that are kept.
WIDTH = 16
#: Batches that a whole table is dealt in, by its files.
BATCHES = 8


def hashes(text: str | None, least_chars: int) -> list[bytes | None]:
    """The key hash of each line of a text, None where the key is shorter than least_chars."""
    keys = [line.strip(BLANK).lower() for line in (text or "").encode("utf-8", "surrogatepass").split(b"\n")]  # of bytes: A-Z alone is lowered
    long = [len(k) >= least_chars and (least_chars <= 1 or len(k.decode("utf-8", "surrogatepass")) >= least_chars) for k in keys]
    return [hashlib.sha256(k).digest()[:WIDTH] if ok else None for k, ok in zip(keys, long, strict=True)]


def hashed_documents(least_chars: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in blocks(frames):
            yield pd.DataFrame({"key": [k for text in frame["text"] for k in set(hashes(text, least_chars)) - {None}]})

    return run


def hashed_lines(least_chars: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in blocks(frames):
            rows = [(i, place, k) for i, text in zip(frame["id"], frame["text"], strict=True) for place, k in enumerate(hashes(text, least_chars)) if k]
            yield pd.DataFrame(rows, columns=["id", "place", "key"])

    return run


def counted(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """key, docs: the number of rows of docs that have a line of this key."""
    keys = docs.select(F.col("text").cast("string").alias("text")).mapInPandas(hashed_documents(least_chars), "key binary")
    return keys.groupBy("key").agg(F.count("*").alias("docs"))


class Levels:
    """Sorted runs by level; two runs of a level become one of the next through merge."""

    def __init__(self, scratch: Scratch, name: str, merge: Callable[[DataFrame, DataFrame], DataFrame]):
        self.scratch, self.spark, self.name, self.merge = scratch, scratch.spark, name, merge
        #: one number of buckets for all runs, so that they meet bucket by bucket
        self.buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[str | None] = []

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for name in self.levels if name]

    def written(self, df: DataFrame) -> str:
        name = f"lapsewise_{self.name}_{uuid.uuid4().hex}"
        df.write.format("parquet").option("compression", "zstd").option("path", f"{self.scratch.base}/{name}").bucketBy(self.buckets, "key").sortBy("key").saveAsTable(name)
        return name

    def forget(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")
        self.scratch.delete(f"{self.scratch.base}/{name}")

    def met(self, a: str, b: str) -> str:
        out = self.written(self.merge(self.spark.table(a), self.spark.table(b)))
        self.forget(a)
        self.forget(b)
        return out

    def add(self, df: DataFrame) -> None:
        run, level = self.written(df), 0
        while level < len(self.levels) and (there := self.levels[level]):
            self.levels[level] = None
            run = self.met(there, run)
            level += 1
        self.levels[level : level + 1] = [run]

    def compact(self) -> DataFrame | None:
        """All runs as one, the small ones first."""
        names = [name for name in self.levels if name]
        self.levels = [reduce(self.met, names)] if names else []
        return self.runs()[0] if names else None

    def clear(self) -> None:
        for name in self.levels:
            if name:
                self.forget(name)
        self.levels = []


class LineRuns:
    """What batches have taught about lines: counts of keys that may yet go, and the keys that are settled to go."""

    def __init__(self, scratch: Scratch, least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS):
        self.scratch, self.least_docs, self.least_chars = scratch, least_docs, least_chars
        self.settled = Levels(scratch, "settled", lambda a, b: a.join(b, "key", "full"))
        self.counts = Levels(scratch, "counts", self.compacted)

    def unsettled(self, counts: DataFrame) -> DataFrame:
        """counts without settled keys: an anti-join as an outer one, which stays above the counting, so that lines are summed before they are shuffled."""
        for run in self.settled.runs():
            counts = counts.join(run.withColumn("known", F.lit(True)).hint("merge"), "key", "left").where("known is null").drop("known")
        return counts

    def compacted(self, a: DataFrame, b: DataFrame) -> DataFrame:
        """The counts of two runs that stay open; those that reach the bound become a settled run."""
        none = F.lit(0).cast("long")
        met = a.hint("merge").join(b.withColumnRenamed("docs", "more"), "key", "full").select("key", (F.coalesce("docs", none) + F.coalesce("more", none)).alias("docs"))
        self.settled.add(met.where(F.col("docs") >= self.least_docs).select("key"))
        return met.where(F.col("docs") < self.least_docs)

    def add(self, batch: DataFrame) -> None:
        self.counts.add(self.unsettled(counted(batch, self.least_chars)))

    def frequent(self) -> DataFrame:
        """key of every line that goes, as of all batches so far, in a table of its own."""
        found = [self.scratch.spark.createDataFrame([], "key binary")]
        if (open_ := self.counts.compact()) is not None:
            found.append(open_.where(F.col("docs") >= self.least_docs).select("key"))
        if (known := self.settled.compact()) is not None:
            found.append(known)
        return self.scratch.table(reduce(DataFrame.unionByName, found).distinct(), "frequent")

    def clear(self) -> None:
        self.settled.clear()
        self.counts.clear()


def drop_lines(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for texts, all_places in batches:
        rows = []
        for text, places in zip(texts, all_places, strict=True):
            lines = (text or "").split("\n")
            gone = set() if places is None else set(places.tolist())
            rows.append((len(lines), len(gone), "\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else text or ""))
        yield pd.DataFrame(rows, columns=["n_lines", "n_dropped", "kept"])


def strip_lines(docs: DataFrame, keys: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """row (all columns of docs, as a struct), n_lines, n_dropped and kept (the text left) of every row.

    Lines meet the keys in a plain shuffle join, which adaptive execution divides where one line is in very many
    documents; only places travel on, and a text is shuffled once.
    """
    text = F.col("text").cast("string")
    own = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), F.coalesce(text, F.lit("")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text.alias("text"), F.substring(F.unhex(F.sha2(own, 256)), 1, WIDTH).alias("id"))
    lines = rows.select("id", "text").mapInPandas(hashed_lines(least_chars), "id binary, place int, key binary")
    hits = lines.join(keys, "key", "left_semi")
    places = hits.groupBy("id").agg(F.collect_set("place").alias("places"))
    dropped = F.pandas_udf(drop_lines, "n_lines long, n_dropped long, kept string")
    out = rows.join(places, "id", "left").select("row", dropped("text", "places").alias("found"))
    return out.select("row", "found.n_lines", "found.n_dropped", "found.kept")


def batches(table: DataFrame, n: int = BATCHES) -> list[DataFrame]:
    """A stored table as at most n batches, each of files of its own, so that no batch reads another's rows."""
    files = sorted(table.inputFiles())
    return [table.sparkSession.read.schema(table.schema).parquet(*files[i::n]) for i in range(min(n, len(files)))]


def dedup_lines(docs: DataFrame, fed: list[DataFrame] | None = None, least_docs: int = LEAST_DOCS) -> DataFrame:
    """strip_lines of docs after all their batches (docs itself, if none are given) have been added to new runs."""
    scratch = Scratch(docs.sparkSession, "lines")
    runs = LineRuns(scratch, least_docs)
    for batch in fed or [docs]:
        runs.add(batch)
    keys = runs.frequent()
    runs.clear()
    return strip_lines(docs, keys)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    out = dedup_lines(docs.select("doc_id", "text"), batches(docs))
    return out.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
e AS (SELECT r, generate_subscripts(ls, 1) AS i, unnest(ls) AS l FROM d),
k AS (SELECT r, i, l, translate(trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS key FROM e),
f AS (SELECT key FROM k WHERE length(key) >= {LEAST_CHARS} GROUP BY key HAVING count(DISTINCT r) >= {LEAST_DOCS}),
m AS (SELECT k.*, f.key IS NOT NULL AS gone FROM k LEFT JOIN f ON f.key = k.key)
SELECT any_value(d.doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m JOIN d ON d.r = m.r GROUP BY m.r
"""
