"""Removal of long byte strings that occur more than once, by interval expansion on a Burrows-Wheeler transform.

A byte is removed when a string of MINIMUM bytes that covers it also starts anywhere else. To deal the work out, each
window of MINIMUM bytes is assigned to its anchor: the K-byte string with the smallest hash in it, the last one on
ties. Equal windows have equal anchors at equal places, so windows meet in the task of their anchor's key. Anchors
that occur once end there. Of the rest, the context (all windows that share the anchor occurrence) is cut out.

- Identical contexts are aggregated first: all their windows repeat.
- Keys with different contexts are gathered in blocks. In each block the suffixes of its contexts are ordered, and
  breadth-first backward extension on their transform derives the common prefixes of neighbouring suffixes by
  increasing length, stopping at MINIMUM: neighbours that no level up to there separates share MINIMUM bytes.
- A key with very many different contexts (the edge of a passage that very many documents share) is divided by the
  bytes that STRIDE neighbouring windows have in common, and, where that still leaves very many, by single windows.

Nulls: a null text counts as empty; a null doc_id stays a row. Rows with equal doc_id are documents of their own;
repeated rows repeat each other's strings. Inside, a row goes by a hash of doc_id and text, so that repeated rows share
their spans, which are equal anyway. Ties between equal strings need no rule, as all go. Extra columns are carried
unchanged in row, whatever their names. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapsewise.llm.shared import Scratch, SpanHash, blocks, encoded, read_table

MINIMUM, K, STRIDE = 200, 32, 16
#: Different contexts of one key beyond which it is divided.
LARGE_KEY = 64
#: Levels at which all rows are looked at.
DENSE = 12
#: Bytes of contexts that one transform covers, on average.
BLOCK_BYTES = 120_000


def anchors_of(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: text number, first and last window start, anchor place (all in the text), key, context hash."""
    raw = np.frombuffer(b"".join(texts), np.uint8)
    size = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(size) - size
    none = np.empty(0, np.int64)
    if len(raw) < MINIMUM:
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    hashed = SpanHash(raw)
    at = np.arange(len(raw) - K + 1)
    key = hashed(at, at + K)
    bits = np.uint64(int(len(raw)).bit_length())
    mask = (np.uint64(1) << bits) - np.uint64(1)
    packed = (key & ~mask) | (mask - at.astype(np.uint64))  # the smallest hash, then the last place
    low, width, span = packed, 1, MINIMUM - K + 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    anchor = (mask - (low & mask)).astype(np.int64)
    # windows that stay within their text
    text = np.repeat(np.arange(len(texts)), np.maximum(size - MINIMUM + 1, 0))
    first = np.cumsum(np.maximum(size - MINIMUM + 1, 0)) - np.maximum(size - MINIMUM + 1, 0)
    start = np.arange(len(text)) - first[text] + begin[text]
    if not len(start):
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    a = anchor[start]
    new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (text[1:] != text[:-1])]))
    lo, hi = start[new], start[np.concatenate([new[1:], [len(start)]]) - 1]
    p, t = a[new], text[new]
    return t, lo - begin[t], hi - begin[t], p - begin[t], key[p], hashed(lo, hi + MINIMUM)


def anchor_keys(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in blocks(frames):
        key, n = np.unique(anchors_of(encoded(frame["text"]))[4], return_counts=True)
        yield pd.DataFrame({"key": key.view(np.int64), "n": n})


def anchor_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in blocks(frames):
        t, lo, hi, p, key, ctx = anchors_of(encoded(frame["text"]))
        yield pd.DataFrame({"key": key.view(np.int64), "ctx": ctx.view(np.int64), "doc_id": frame["doc_id"].to_numpy()[t], "lo": lo.astype(np.int32), "hi": hi.astype(np.int32), "p": p.astype(np.int32)})


def cut_contexts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The bytes of each context (key, spot: lo, hi, p) of a document; contexts of large keys cut into strides."""
    for frame in blocks(frames):
        rows = []
        for doc, text, spots in zip(frame["doc_id"], encoded(frame["text"]), frame["spots"], strict=True):
            raw = np.frombuffer(text, np.uint8)
            hashed = SpanHash(raw) if any(s["large"] for s in spots) else None
            for s in spots:
                lo, hi, p = s["lo"], s["hi"], s["p"]
                if not s["large"]:
                    rows.append((s["key"], 0, doc, lo, text[lo : hi + MINIMUM]))
                    continue
                j = np.arange((p - hi) // STRIDE, (p - lo) // STRIDE + 1)
                inner = hashed(p - STRIDE * j, p - STRIDE * j - STRIDE + 1 + MINIMUM)
                first, last = np.maximum(lo, p - STRIDE * j - STRIDE + 1), np.minimum(hi, p - STRIDE * j)
                whole = hashed(first, last + MINIMUM).view(np.int64)
                rows.extend((k, w, doc, f, text[f : e + MINIMUM]) for k, w, f, e in zip((inner ^ np.uint64(s["key"] & 0xFFFFFFFFFFFFFFFF)).view(np.int64).tolist(), whole.tolist(), first.tolist(), last.tolist(), strict=True))
        yield pd.DataFrame(rows, columns=["key", "ctx", "doc_id", "lo", "bytes"])


def transform(contexts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the concatenated contexts, each followed by a terminator (0), and the order of its suffixes.

    The order is by the first MINIMUM symbols or more; neighbours that agree in those may stand either way, which
    changes no interval of a string up to that length.
    """
    joined = np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8)
    n = len(joined)
    present = np.zeros(257, bool)
    present[joined.astype(np.int64) + 1] = True
    present[0] = True
    code = np.cumsum(present) - 1
    symbol = code[joined.astype(np.int64) + 1]
    symbol[np.cumsum([len(c) + 1 for c in contexts]) - 1] = 0
    bits = int(code[-1]).bit_length()
    reach = 62 // bits  # as many symbols as one number holds
    padded = np.concatenate([symbol, np.zeros(reach, np.int64)])
    key = np.zeros(n, np.int64)
    for k in range(reach):
        key = (key << bits) | padded[k : k + n]
    wide = n.bit_length() + 1
    times = 3 if 3 * wide <= 62 else 2
    while True:
        order = np.argsort(key)
        key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[1], key[1:] != key[:-1]]))
        if reach >= MINIMUM or rank[order[-1]] == n:
            return symbol, order
        key = rank.copy()  # then by the ranks of the next stretches
        for k in range(1, times):
            key <<= wide
            key[: max(0, n - k * reach)] |= rank[k * reach :]
        reach *= times


def repeated_suffixes(symbol: np.ndarray, order: np.ndarray, minimum: int) -> np.ndarray:
    """True at j if the suffixes order[j-1] and order[j] share at least minimum symbols.

    split[j] holds when some level has separated j-1 from j. Backward extension maps the interval of a string w to
    the interval of cw: the places of c inside w's interval, in order. Two neighbours of the c-block are therefore
    separated at the next level exactly when a separation lies between the two places they come from.
    """
    n = len(order)
    before = symbol[order - 1]  # the transform
    source = np.argsort(before, kind="stable")  # place in the transform of each row, by last-to-first mapping
    first = before[source]
    split = np.ones(n, bool)
    split[1:] = first[1:] != first[:-1]
    open_ = np.flatnonzero(~split[1:]) + 1
    upper, lower = source[open_].astype(np.int32), source[open_ - 1].astype(np.int32)
    new = np.flatnonzero(split)
    depth = 1
    while depth < min(minimum, DENSE) and len(new):  # most rows part within a few levels: look at all of them
        level = np.cumsum(split, dtype=np.int32)
        apart = level[upper] != level[lower]
        new = open_[apart]
        split[new] = True
        open_, upper, lower = open_[~apart], upper[~apart], lower[~apart]
        depth += 1
    # then follow what has just parted: rows that come from neighbours are reached straight from there
    target = np.empty(n, np.int64)
    target[source] = np.arange(n)
    near = np.zeros(n, bool)
    close = upper == lower + 1
    near[open_[close]] = True
    open_, upper, lower = open_[~close], upper[~close], lower[~close]
    while depth < minimum and len(new):
        new = np.sort(new)
        reached = target[new]
        reached = reached[near[reached]]
        apart = np.searchsorted(new, upper, "right") > np.searchsorted(new, lower, "right")
        new = np.concatenate([reached, open_[apart]])
        split[new] = True
        near[reached] = False
        open_, upper, lower = open_[~apart], upper[~apart], lower[~apart]
        depth += 1
    return ~split


def repeats_in_block(frame: pd.DataFrame) -> pd.DataFrame:
    """Spans of bytes covered by strings that two places of this block share."""
    contexts = [bytes(b) for b in frame["bytes"]]
    symbol, order = transform(contexts)
    size = np.array([len(c) + 1 for c in contexts])
    begin = np.cumsum(size) - size
    same = np.flatnonzero(repeated_suffixes(symbol, order, MINIMUM))
    hit = np.zeros(len(order), bool)
    hit[order[same]] = True
    hit[order[same - 1]] = True
    at = np.flatnonzero(hit)
    c = np.searchsorted(begin, at, "right") - 1
    inside = at + MINIMUM < begin[c] + size[c]  # a string over a terminator is none
    at, c = at[inside], c[inside]
    if not len(at):
        return pd.DataFrame({"doc_id": np.empty(0, np.int64), "start": np.empty(0, np.int64), "stop": np.empty(0, np.int64)})
    place = at - begin[c] + frame["lo"].to_numpy()[c]
    new = np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]) | (place[1:] > place[:-1] + MINIMUM)]))
    return pd.DataFrame({"doc_id": frame["doc_id"].to_numpy()[c[new]], "start": place[new], "stop": place[np.concatenate([new[1:], [len(at)]]) - 1] + MINIMUM})


def window_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Every window of a context, for the few strides that very many different contexts share."""
    for frame in frames:
        texts = [bytes(b) for b in frame["bytes"]]
        if not texts:
            continue
        hashed = SpanHash(np.frombuffer(b"".join(texts), np.uint8))
        size = np.array([len(t) for t in texts], np.int64)
        begin, many = np.cumsum(size) - size, size - MINIMUM + 1
        c = np.repeat(np.arange(len(texts)), many)
        offset = np.arange(len(c)) - (np.cumsum(many) - many)[c]
        start = begin[c] + offset
        yield pd.DataFrame({"window": hashed(start, start + MINIMUM).view(np.int64), "doc_id": frame["doc_id"].to_numpy()[c], "start": frame["lo"].to_numpy()[c] + offset})


def repeated_spans(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, start, stop): byte spans, possibly overlapping, covered by strings that occur more than once."""
    docs = docs.select("doc_id", "text")
    keys = docs.select("doc_id", "text").mapInPandas(anchor_keys, "key long, n long")
    multi = scratch.table(keys.groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key"), "keys")
    rows = docs.mapInPandas(anchor_rows, "key long, ctx long, doc_id long, lo int, hi int, p int")
    hits = scratch.table(rows.join(multi, "key"), "hits")
    contexts = hits.groupBy("key", "ctx").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "lo", "hi", "p")).alias("at"))
    contexts = scratch.table(contexts, "contexts")
    exact = hits.join(contexts.where("n > 1").select("key", "ctx"), ["key", "ctx"], "left_semi")
    exact = exact.select("doc_id", F.col("lo").cast("long").alias("start"), (F.col("hi") + F.lit(MINIMUM)).cast("long").alias("stop"))

    varied = contexts.groupBy("key").agg(F.count("*").alias("k")).where("k > 1").select("key", (F.col("k") > LARGE_KEY).alias("large"))
    spots = contexts.join(scratch.table(varied, "varied"), "key")
    spots = spots.groupBy("at.doc_id").agg(F.collect_list(F.struct("key", "at.lo", "at.hi", "at.p", "large")).alias("spots"))
    cut = docs.join(spots, "doc_id").select("doc_id", "text", "spots").mapInPandas(cut_contexts, "key long, ctx long, doc_id long, lo long, bytes binary")
    cut = scratch.table(cut, "cut")
    whole, strides = cut.where("ctx = 0"), cut.where("ctx <> 0")
    # strides of one context are the same bytes: where there are two, all are repeats, and one stands for them against others
    each = strides.groupBy("key", "ctx").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "lo", "bytes")).alias("at"))
    each = scratch.table(each, "strides")
    single = strides.join(each.where("n > 1").select("key", "ctx"), ["key", "ctx"], "left_semi").select("doc_id", F.col("lo").alias("start"), (F.col("lo") + F.length("bytes")).alias("stop"))
    per = each.groupBy("key").agg(F.count("*").alias("k")).where("k > 1")
    strides = scratch.table(each.join(per, "key").select("key", "ctx", "at.doc_id", "at.lo", "at.bytes", "k"), "stride-rows")
    mixed = whole.unionByName(strides.where(F.col("k") <= LARGE_KEY * STRIDE).drop("k"))
    total = mixed.agg(F.sum(F.length("bytes"))).first()[0] or 0
    by_block = mixed.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(1 + total // BLOCK_BYTES)))
    span = "doc_id long, start long, stop long"
    expanded = by_block.groupBy("block").applyInPandas(repeats_in_block, span)
    wide = strides.where(F.col("k") > LARGE_KEY * STRIDE).mapInPandas(window_rows, "window long, doc_id long, start long")
    wide = scratch.table(wide, "windows")
    again = scratch.table(wide.groupBy("window").agg(F.count("*").alias("n")).where("n > 1").select("window"), "window-keys")
    wide = wide.join(again, "window").select("doc_id", "start", (F.col("start") + MINIMUM).alias("stop"))
    return exact.unionByName(expanded).unionByName(single).unionByName(wide)


def removed_runs(spans: list | None) -> list[tuple[int, int]]:
    """Maximal runs of the union of spans."""
    out: list[list[int]] = []
    for s in sorted((s["start"], s["stop"]) for s in (spans if spans is not None else [])):
        if out and s[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s[1])
        else:
            out.append(list(s))
    return [(a, b) for a, b in out]


def strip_runs(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for texts, all_spans in batches:
        kept, runs, size = [], [], []
        for whole, spans in zip(texts, all_spans, strict=True):
            text, own = b"" if whole is None else whole.encode("utf-8", "surrogatepass"), removed_runs(spans)
            bounds = [0, *(x for run in own for x in run), len(text)]
            kept.append(b"".join(text[a:b] for a, b in zip(bounds[::2], bounds[1::2], strict=True)))
            runs.append([{"start": a, "stop": b} for a, b in own])
            size.append(len(text))
        yield pd.DataFrame({"n_bytes": size, "removed": runs, "kept": kept})


def strip_repeats(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """row (all columns of docs, as a struct), n_bytes, removed (maximal runs) and kept (the remaining bytes) of every row."""
    scratch = scratch or Scratch(docs.sparkSession, "suffix")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("doc_id", F.xxhash64("row.doc_id", "text"))
    spans = repeated_spans(rows.select("doc_id", "text"), scratch).distinct()
    spans = scratch.table(spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop")).alias("spans")), "spans")
    stripped = F.pandas_udf(strip_runs, "n_bytes long, removed array<struct<start:long,stop:long>>, kept binary")
    rows = rows.join(spans, "doc_id", "left").select("row", stripped("text", "spans").alias("found"))
    return rows.select("row", "found.n_bytes", "found.removed", "found.kept")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = strip_repeats(read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda acc, r: acc + r["stop"] - r["start"])
    return out.select("row.doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: All windows of all texts, as hex digits: for the small tables of the SQL check.
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, i, md5(substr(h, (2 * i + 1)::BIGINT, {2 * MINIMUM})) AS k FROM (SELECT r, h, unnest(range(0, len(h) // 2 - {MINIMUM - 1})) AS i FROM d)),
hit AS (SELECT r, i FROM w SEMI JOIN (SELECT k FROM w GROUP BY k HAVING count(*) > 1) USING (k)),
mark AS (SELECT r, i, CASE WHEN i > lag(i) OVER o + {MINIMUM} THEN 1 ELSE 0 END AS fresh FROM hit WINDOW o AS (PARTITION BY r ORDER BY i)),
runs AS (SELECT r, min(i) AS lo, max(i) + {MINIMUM} AS hi FROM (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS run FROM mark) GROUP BY r, run),
cuts AS (SELECT r, coalesce(lag(hi) OVER (PARTITION BY r ORDER BY lo), 0) AS a, lo AS b FROM runs UNION ALL SELECT d.r, coalesce(max(hi), 0), len(any_value(h)) // 2 FROM d LEFT JOIN runs ON runs.r = d.r GROUP BY d.r),
kept AS (SELECT d.r, string_agg(substr(h, (2 * a + 1)::BIGINT, (2 * (b - a))::BIGINT), '' ORDER BY a) AS left_ FROM cuts JOIN d ON d.r = cuts.r GROUP BY d.r),
sums AS (SELECT r, sum(hi - lo)::BIGINT AS n_removed, count(*) AS n_spans FROM runs GROUP BY r)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(left_)) AS kept_sha256
FROM d JOIN kept ON kept.r = d.r LEFT JOIN sums ON sums.r = d.r
"""


def brute_force(texts: dict[int, bytes], minimum: int = MINIMUM) -> dict[int, tuple[int, int, int, str]]:
    """The same digest by comparing all windows, for small tables."""
    seen: dict[bytes, int] = {}
    for t in texts.values():
        for i in range(len(t) - minimum + 1):
            w = t[i : i + minimum]
            seen[w] = seen.get(w, 0) + 1
    out = {}
    for doc, t in texts.items():
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - minimum + 1):
            if seen[t[i : i + minimum]] > 1:
                gone[i : i + minimum] = True
        gone = gone[: len(t)]
        runs = int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum())
        out[doc] = (len(t), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest())
    return out
