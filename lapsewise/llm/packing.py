"""Packing of token pieces into sequences of fixed capacity by exact-complement hashing, then best fit.

Texts become ids; texts of more than CAPACITY ids are cut into full pieces, the first piece taking the rest. What has
to be packed is then the number of pieces of each length, a table of at most CAPACITY rows whatever the corpus size.
On that table the plan is made: the longest length left opens a sequence; an index of the lengths, pair sums and triple
sums still available is asked for the combination that fills the gap exactly, which is consumed as often as the counts
allow; where none exists, the best fitting length left goes in. The plan is a list of patterns with multiplicities. Pieces
are numbered within their length by two prefix sums and take the slots of their length in order.

Nulls: a null text is an empty one (the end id alone), a null doc_id is a document without a number. Rows with equal doc_id
and repeated rows are separate documents, each packed. Ties: pieces of one length take its slots by doc_id, place and ids;
which of two equal pieces comes first changes nothing but their numbers. Extra columns are ignored, empty tables give empty
results.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lapsewise.llm.shared import Scratch, blocks, read_table

CAPACITY, END = 1024, 2
#: Distinct chunks that a Python worker remembers.
REMEMBERED = 400_000
#: Pieces of a part on average: what one task numbers.
PART = 50_000
SPECIAL = "<|endoftext|>"


class ChunkEncoder:
    """Byte-level BPE ids as little-endian 32-bit words.

    A text is split at single spaces. The tokenizer's own pattern never lets a token run across the place before a
    space that stands between two visible characters, so each " word" can be looked up on its own; a text with other
    white space next to a space, or with the special string, is encoded whole by the tokenizer itself.
    """

    def __init__(self, tokenizer: str, ranks: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(public_tokenizers.path(tokenizer))
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(ranks), "rb"))}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.known: dict[str, bytes] = {}

    def chunk(self, c: str) -> bytes:
        if not c or c[0].isspace() or c[-1].isspace():
            raise ValueError
        out = np.array(self.fast.encode_ordinary(" " + c), "<u4").tobytes()
        if len(self.known) < REMEMBERED:
            self.known[c] = out
        return out

    def __call__(self, text: str) -> bytes:
        if SPECIAL not in text and text:
            first, *rest = text.split(" ")
            get, chunk = self.known.get, self.chunk
            try:
                if first and not first[0].isspace() and not first[-1].isspace():
                    return np.array(self.fast.encode_ordinary(first), "<u4").tobytes() + b"".join([get(c) or chunk(c) for c in rest])
            except ValueError:
                pass
            return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


_ENCODERS: dict[tuple[str, str], ChunkEncoder] = {}


def encoder(tokenizer: str, ranks: str) -> ChunkEncoder:
    if (tokenizer, ranks) not in _ENCODERS:
        _ENCODERS[tokenizer, ranks] = ChunkEncoder(tokenizer, ranks)
    return _ENCODERS[tokenizer, ranks]


def cutter(tokenizer: str, ranks: str, capacity: int, with_ids: bool):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer, ranks)
        end = np.array([END], "<u4").tobytes()
        for frame in blocks(frames):
            rows = []
            for doc, text in zip(frame["doc_id"], frame["text"], strict=True):
                doc = int(doc) if isinstance(doc, str) else None
                ids = encode(text or "") + end
                n = len(ids) // 4
                bounds = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    part = ids[4 * a : 4 * b]
                    rows.append((doc, k, a, b - a, zlib.crc32(part), *([np.frombuffer(part, "<u4").astype(np.int32)] if with_ids else [])))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])
            yield out.assign(doc_id=pd.array([r[0] for r in rows], "Int64"))

    return run


def pieces(docs: DataFrame, capacity: int = CAPACITY, with_ids: bool = False, tokenizer: str = "byte_bpe_50k.json", ranks: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of each piece of at most capacity ids."""
    # ids travel as text: a null among numbers would turn them into floating ones
    docs = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInPandas(cutter(tokenizer, ranks, capacity, with_ids), "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


class SumIndex:
    """Which lengths add up to a gap, singly, in pairs and in threes, among those that may still be available.

    Pairs are listed by their sum once, each with its longer member first and the longest first. Threes of a sum are a
    length and a pair of the rest that is no longer. Counts only fall, so a combination that is used up never comes back:
    whoever walks the combinations of a gap once has seen all that it will ever have.
    """

    def __init__(self, lengths: list[int], capacity: int):
        self.lengths = sorted(lengths, reverse=True)
        self.pairs: dict[int, list[tuple[int, int]]] = {}
        for x in self.lengths:
            for y in self.lengths:
                if y <= x and x + y <= capacity:
                    self.pairs.setdefault(x + y, []).append((x, y))
        self.singles = set(lengths)

    def combinations(self, gap: int) -> Iterator[tuple[int, ...]]:
        if gap in self.singles:
            yield (gap,)
        yield from self.pairs.get(gap, ())
        for x in self.lengths:
            if x < gap:
                for y, z in self.pairs.get(gap - x, ()):
                    if y <= x:
                        yield (x, y, z)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths with multiplicities that use up counts: exact complements first, best fit for the rest."""
    left = {length: n for length, n in counts.items() if n > 0}
    index = SumIndex(list(left), capacity)
    out: list[tuple[tuple[int, ...], int]] = []

    def take(pattern: tuple[int, ...]) -> bool:
        """The pattern as often as the counts allow."""
        n = min(left[x] // pattern.count(x) for x in pattern)
        if n:
            for x in pattern:
                left[x] -= n
            out.append((pattern, n))
        return n > 0

    for first in index.lengths:
        gap = capacity - first
        if not gap:
            take((first,))
            continue
        for others in index.combinations(gap):
            if not left[first]:
                break
            take((first, *others))
        while left[first]:
            # no exact complement: best fit, longest first, as often as the counts allow
            pattern, room = (first,), gap
            while fit := next((x for x in index.lengths if x <= room and left[x] > pattern.count(x)), 0):
                pattern += (fit,)
                room -= fit
            take(pattern)
    return out


def pack(items: DataFrame, capacity: int = CAPACITY, scratch: Scratch | None = None) -> DataFrame:
    """items (with doc_id, piece, length) plus sequence_id and offset; offsets in a sequence are gapless from 0."""
    spark = items.sparkSession
    scratch = scratch or Scratch(spark, "packing")
    # numbers within a length: a deal of hashed parts, numbered inside, after the parts before it
    items = scratch.table(items, "pieces")
    parts = max(16, 1 + items.count() // PART)
    items = items.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)))
    per = items.groupBy("length", "part").agg(F.count("*").alias("n"))
    per = scratch.table(per, "per-part")
    counts = {r["length"]: r["n"] for r in per.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    before = per.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    slots, sequence = [], 0
    at = dict.fromkeys(counts, 0)
    for pattern, n in plan(counts, capacity):
        offset = 0
        for length in sorted(set(pattern), reverse=True):
            k = pattern.count(length)
            # piece number r of this length, r0 <= r < r0 + n * k: sequence r // k of the pattern, place r % k in it
            slots.append((length, at[length], at[length] + n * k, k, sequence, offset))
            at[length] += n * k
            offset += k * length
        sequence += n
    slots = spark.createDataFrame(slots, "slot_length long, first long, past long, k long, sequence long, base long")
    inside = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")) - 1
    numbered = items.withColumn("inside", inside).join(before, ["length", "part"])
    numbered = numbered.withColumn("number", F.col("inside") + F.col("before")).drop("inside", "before", "part")
    # the slot table has a few rows for each length: no more than the plan has patterns
    where = (F.col("length") == F.col("slot_length")) & (F.col("number") >= F.col("first")) & (F.col("number") < F.col("past"))
    placed = numbered.join(F.broadcast(slots), where)
    placed = placed.withColumn("sequence_id", F.col("sequence") + F.expr("(number - first) div k")).withColumn("offset", F.col("base") + (F.col("number") - F.col("first")) % F.col("k") * F.col("length"))
    return placed.drop("slot_length", "first", "past", "k", "sequence", "base", "number")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack(pieces(read_table(spark, sf_dir, "documents")))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
