"""Language-model scores by Brown classes.

Every word seen at least LEAST times is put into one of CLASSES classes by exchange clustering: each word moves to the
class in which the class bigram likelihood is highest. The TOP most frequent words start the classes on the driver, one
word after the other; then Spark counts, for every word, the classes before and after it, and all words move at once by
these counts and the small table of class bigrams: those that travel in SPREAD rounds, of which the one with the highest
likelihood stands, then the rarer ones, once. Words seen less often stand for the unseen: they share classes by length
with them. A token's probability is that of its class after the class before it, smoothed towards the class's own
probability, times that of the word in its class.

Words are counted by 64-bit hash. Words at or above a cut, chosen so that at most KNOWN words reach it, travel as a table
of bounded size. The corpus is written once as the numbers of these words by falling frequency, with the hashes of all
others; every later pass reads that. A rarer word's neighbours tell its class, and until it has one it counts as a
neighbour by its length, so no bigram is shuffled but those of two words that do not travel, once; class bigrams are
then corrected for the words that moved. Class bigrams are a table of bounded size. The words in classes, and what is
shuffled, grow with the corpus, what a task or the driver holds does not.

Nulls: a null text is empty (its end token alone is scored); a null doc_id stays a row and trains (its remainder is
undefined, held_out is false). Repeated rows train repeatedly, and every row of the input is one of the result, whether or
not others share its doc_id. Ties between classes go to the first. Extra columns are ignored; empty tables give empty
results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapsewise.llm.langid import remainder
from lapsewise.llm.shared import _SPACE, Scratch, _LOWER, block_hashes, blocks, encoded, read_table

TOP, CLASSES, ROUNDS, KNOWN, LENGTHS = 1000, 40, 4, 1 << 18, 6
#: Occurrences that put a word into a class, and rounds over all such words; evidence rows that a task gathers at once.
LEAST, SPREAD, GATHERED = 5, 2, 1_000_000
KAPPA, HOLDOUT, MODULUS = 5.0, 2, 7


def tokens_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and length class of every word of all texts in order, and the words of each text."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = _SPACE[raw]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[0::2], edge[1::2]
    start = start[: len(end)]
    bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    per = np.diff(np.searchsorted(start, bounds))
    return block_hashes(_LOWER[raw], start, end).view(np.int64), np.minimum((end - start - 1) // 3, LENGTHS - 1), per


def count_words(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in blocks(frames):
        word, kind, _ = tokens_of(encoded(frame["text"]))
        word, first, n = np.unique(word, return_index=True, return_counts=True)
        yield pd.DataFrame({"word": word, "kind": kind[first].astype(np.int32), "n": n})


def lookup(table: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Places of words in the sorted table, -1 where there is none."""
    if not len(table):
        return np.full(len(words), -1)
    at = np.minimum(np.searchsorted(table, words), len(table) - 1)
    return np.where(table[at] == words, at, -1)


def exchange(pairs: np.ndarray, top: int, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """Class of every symbol; only the first top symbols move, each of the others is a class of its own.

    pairs: symbol bigram counts, symbols in order of falling frequency up to top.
    """
    n = len(pairs)
    k = min(classes, max(1, top))
    label = np.concatenate([np.arange(top) % k, k + np.arange(n - top)])
    size = k + n - top
    pairs = pairs.astype(np.float64)
    grown = np.zeros((n, size))
    grown[np.arange(n), label] = 1
    out, into = pairs @ grown, pairs.T @ grown  # of each symbol: counts with the classes after and before it
    counts = grown.T @ out
    phi = lambda x: x * np.log(np.maximum(x, 1e-300))
    members = np.bincount(label, minlength=size)
    for _ in range(rounds):
        moved = 0
        for w in range(top):
            a = label[w]
            if members[a] == 1:
                continue
            own = pairs[w, w]
            o, i = out[w].copy(), into[w].copy()
            o[a] -= own
            i[a] -= own  # without w's own pair
            counts[a] -= o
            counts[:, a] -= i
            counts[a, a] -= own
            row, col = counts.sum(axis=1), counts.sum(axis=0)
            gain = (phi(counts[:k] + o) - phi(counts[:k])).sum(axis=1) + (phi(counts[:, :k] + i[:, None]) - phi(counts[:, :k])).sum(axis=0)
            d = np.arange(k)
            diag = counts[d, d]
            gain += phi(diag + o[d] + i[d] + own) - phi(diag + o[d]) - phi(diag + i[d]) + phi(diag)
            gain -= phi(row[:k] + o.sum() + own) - phi(row[:k]) + phi(col[:k] + i.sum() + own) - phi(col[:k])
            b = int(gain.argmax())
            if gain[b] <= gain[a] + 1e-9:
                b = a
            counts[b] += o
            counts[:, b] += i
            counts[b, b] += own
            if b != a:
                moved += 1
                label[w] = b
                members[a] -= 1
                members[b] += 1
                out[:, a] -= pairs[:, w]
                out[:, b] += pairs[:, w]
                into[:, a] -= pairs[w]
                into[:, b] += pairs[w]
        if not moved:
            break
    return label


def gains(joint: np.ndarray, k: int, at: np.ndarray, out: np.ndarray, into: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Gain in class bigram likelihood of each word (row) in each of the k word classes, against being in no class.

    joint: class bigrams with all words where they are (at); out, into: of each word, counts with the classes after and
    before it, without its pairs with itself (own).
    """
    phi = lambda x: x * np.log(np.maximum(x, 1e-300))
    n, each, d = len(at), np.arange(len(at)), np.arange(k)
    gain = np.zeros((n, k))
    held = at[:, None] == d
    for side, other, table in ((out, into, joint), (into, out, joint.T)):
        part = np.zeros((n, k))
        w, c = np.nonzero(side)
        away = c != at[w]
        w, c = w[away], c[away]
        for i in range(0, len(w), 50_000):  # cells that the word's own leaving does not touch
            rows, cols = w[i : i + 50_000], c[i : i + 50_000]
            cell = table[:k, cols].T
            step = phi(cell + side[rows, cols][:, None]) - phi(cell)
            first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
            part[rows[first]] += np.add.reduceat(step, first)
        cell = table[:k, at].T - other[:, :k]
        part += phi(cell + side[each, at][:, None]) - phi(cell)
        left = table[at] - side
        left[each, at] -= other[each, at] + own
        back = (phi(left + side) - phi(left)).sum(axis=1)
        gain += np.where(held, back[:, None], part)
        whole = table.sum(axis=1)[None, :k] - held * (side.sum(axis=1) + own)[:, None]
        gain -= phi(whole + (side.sum(axis=1) + own)[:, None]) - phi(whole)
    o, i, s = out[:, :k], into[:, :k], own[:, None]
    diag = joint[d, d][None] - held * (o + i + s)
    return gain + phi(diag + o + i + s) - phi(diag + o) - phi(diag + i) + phi(diag)


def likelihood(joint: np.ndarray) -> float:
    phi = lambda x: float((x * np.log(np.maximum(x, 1e-300))).sum())
    return phi(joint) - phi(joint.sum(axis=0)) - phi(joint.sum(axis=1))


class Known:
    """Words that travel: sorted hashes, counts, classes; size counts the word classes k, the lengths and the edge.

    code: numbers of symbols. The words by falling count (order: their places), then the lengths of all others, then the
    edge of a text.
    """

    def __init__(self, word: np.ndarray, n: np.ndarray, label: np.ndarray, k: int, some_rarer: bool):
        self.word, self.n, self.label, self.k, self.some_rarer = word, n, label, k, some_rarer
        self.size = k + LENGTHS + 1
        self.order = np.lexsort((word, -n))
        self.rest, self.edge = len(word), len(word) + LENGTHS

    def of_codes(self, words: np.ndarray, others: np.ndarray, edge: float) -> np.ndarray:
        """Table by code of what is given by place, by length and for the edge."""
        return np.concatenate([words[self.order], others, [edge]])

    def labels(self) -> np.ndarray:
        return self.of_codes(self.label, self.k + np.arange(LENGTHS), self.size - 1).astype(np.int64)


EVIDENCE = "word long, label int, codes array<long>"
#: Codes and counts share a long: code << COUNT | n.
COUNT = 40


def packed(word: np.ndarray | None, label: np.ndarray, code: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Evidence sorted by word, label and code, in one row for each word, or label where there is no word."""
    own = label if word is None else word
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(own)), bool), own[1:] != own[:-1]]))
    codes = pa.ListArray.from_arrays(pa.array(np.append(first, len(own)), pa.int32()), pa.array((code << COUNT) + n, pa.int64()))
    words = pa.nulls(len(first), pa.int64()) if word is None else pa.array(word[first], pa.int64())
    return pa.RecordBatch.from_arrays([words, pa.array(label[first], pa.int32()), codes], ["word", "label", "codes"])


ENCODED = "row long, doc_id long, held_out boolean, low binary, high binary, rare binary"


def encode(shared):
    """Every text as its edge and the codes of its words (two bytes low, one byte high), and the hashes of the words that do not travel.

    row: number of the task and of the row in it. What is returned is written before it is read, so the numbers stay.
    """

    def column(values: np.ndarray, per: np.ndarray) -> pa.Array:
        ends = np.concatenate([[0], np.cumsum(per)]) * values.itemsize
        return pa.Array.from_buffers(pa.binary(), len(per), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, made = shared.value, TaskContext.get().partitionId() << 40
        rank = np.empty(len(known.word), np.int64)
        rank[known.order] = np.arange(len(known.word))
        for frame in blocks(batch.to_pandas() for batch in batches):
            word, kind, per = tokens_of(encoded(frame["text"]))
            at = lookup(known.word, word)
            here = at >= 0
            code = np.full(len(word) + len(per), known.edge, np.uint32)
            owner = np.repeat(np.arange(len(per)), per)
            code[np.arange(len(word)) + owner + 1] = np.where(here, rank[np.maximum(at, 0)] if len(rank) else 0, known.rest + kind)
            columns = [pa.array(made + np.arange(len(per))), pa.array(frame["doc_id"], pa.int64(), from_pandas=True), pa.array(frame["held_out"], pa.bool_())]
            columns += [column((code & 0xFFFF).astype(np.uint16), per + 1), column((code >> 16).astype(np.uint8), per + 1), column(word[~here], np.bincount(owner[~here], minlength=len(per)))]
            made += len(per)
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "held_out", "low", "high", "rare"])

    return run


def flat(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The numbers in all rows of a column of bytes, and how many there are before each row and in all."""
    ends = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset).astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and ends[-1] > ends[0] else np.zeros(0, np.uint8)
    return raw.view(kind), (ends - ends[0]) // np.dtype(kind).itemsize


#: Codes that one vectorised step works on.
STEP = 500_000


def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows of encoded texts, about STEP codes at a time: the rows, their codes with an edge at the end, and the codes of each row."""
    for batch in batches:
        if not len(batch):
            continue
        low, ends = flat(batch.column("low"), np.uint16)
        high, _ = flat(batch.column("high"), np.uint8)
        first = 0
        while first < len(batch):
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + STEP, "right")) - 1)
            own = slice(ends[first], ends[last])
            code = low[own] | high[own].astype(np.int64) << 16
            yield batch.slice(first, last - first), np.append(code, code[0]), np.diff(ends[first : last + 1])
            first = last


def count_pairs(table, size: int):
    """Bigrams of symbols, which the broadcast table gives by code: pair is first * size + second."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = table.value
        joint = np.zeros(size * size, np.int64)
        for _, code, _ in stretches(batches):
            symbol = of[code]
            joint += np.bincount(symbol[:-1] * size + symbol[1:], minlength=size * size)
        pair = np.flatnonzero(joint)
        yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(joint[pair])], ["pair", "n"])

    return run


def bigrams(training: DataFrame, table: np.ndarray, size: int) -> np.ndarray:
    """Counts of bigrams of the size symbols that table gives by code."""
    shared = training.sparkSession.sparkContext.broadcast(table)
    found = training.mapInArrow(count_pairs(shared, size), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    joint = np.zeros(size * size)
    joint[found["pair"].to_numpy()] = found["n"].to_numpy()
    return joint.reshape(size, size)


def gather(shared):
    """Of a travelling word (its code) in class label, codes: the class after it, size + the class before it, or 2 size for the word itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, found, waiting = shared.value, [], 0
        size, labels = known.size, known.labels()
        moving = known.of_codes(known.n >= LEAST, np.zeros(LENGTHS, bool), False).astype(bool)

        def flush() -> pa.RecordBatch:
            keys, counts = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(keys, kind="stable")  # sorted stretches, merged
            keys = keys[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            key, n = keys[first], np.add.reduceat(counts[order], first)
            word = key // (2 * size + 1)
            return packed(word, labels[word], key % (2 * size + 1), n)

        for _, code, _ in stretches(batches):
            label, moves = labels[code], moving[code]
            x, y = code[:-1], code[1:]
            after = x * (2 * size + 1) + np.where(x == y, 2 * size, label[1:])
            before = y * (2 * size + 1) + size + label[:-1]
            found.append(np.unique(np.concatenate([after[moves[:-1]], before[moves[1:] & (x != y)]]), return_counts=True))
            waiting += len(found[-1][0])
            if waiting > GATHERED:
                yield flush()
                found, waiting = [], 0
        if waiting:
            yield flush()

    return run


def rare_words(shared):
    """Words that do not travel, one row for each time: code is (length, class before, class after) to the base of size + 1.

    size stands for the word itself: after it, and for nothing before it, as that pair is told by the one before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        size, labels = known.size, known.labels()
        for rows, code, _ in stretches(batches):
            at = np.flatnonzero((code >= known.rest) & (code < known.edge))
            word, _ = flat(rows.column("rare"), np.int64)
            again = (at[1:] == at[:-1] + 1) & (word[1:] == word[:-1])
            before, after = labels[code[at - 1]], labels[code[at + 1]]
            before[1:][again], after[:-1][again] = size, size
            codes = ((code[at] - known.rest) * (size + 1) + before) * (size + 1) + after
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(codes.astype(np.int32))], ["word", "code"])

    return run


def rare_pairs(shared):
    """Bigrams of two words that do not travel, by row; kinds: both lengths to the base of LENGTHS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for rows, code, per in stretches(batches):
            at = np.flatnonzero((code >= known.rest) & (code < known.edge))
            word, _ = flat(rows.column("rare"), np.int64)
            i = np.flatnonzero(at[1:] == at[:-1] + 1)
            owner, kind = np.repeat(np.arange(len(per)), per)[at[i]], code[at] - known.rest
            keys = np.stack([owner, word[i], word[i + 1], kind[i] * LENGTHS + kind[i + 1]])
            keys, tf = tallied(keys)
            row = rows.column("row").to_numpy()
            held = rows.column("held_out").take(pa.array(keys[0]))
            yield pa.RecordBatch.from_arrays([pa.array(row[keys[0]]), held, pa.array(keys[1]), pa.array(keys[2]), pa.array(keys[3].astype(np.int32)), pa.array(tf)], ["row", "held_out", "w1", "w2", "kinds", "tf"])

    return run


PAIRS = "row long, held_out boolean, w1 long, w2 long, kinds int, tf long"


def tallied(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct columns and how often each is there."""
    keys = keys[:, np.lexsort(keys[::-1])]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, keys.shape[1]), bool), (keys[:, 1:] != keys[:, :-1]).any(axis=0)]))
    return keys[:, first], np.diff(np.append(first, keys.shape[1]))


def both(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """pairs with l1 and l2: the label in table (word, label) of either side."""
    columns = pairs.columns
    for s in "12":
        pairs = pairs.join(table.select(F.col("word").alias(f"w{s}"), F.col("label").alias(f"l{s}")), f"w{s}", "left")
    return pairs.select(*columns, "l1", "l2")


MOVED = "word long, label int, code int, n long"


def move_rare(joint: np.ndarray, k: int):
    """Best class of every rarer word from the rows of rare_words and one with code -1 that says it has a class, sorted
    by word and code; then (word null) what its leaving its length does to the bigrams with travelling words and edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(joint)
        width, base = 2 * size + 1, size + 1
        told = np.r_[0:k, size - 1]  # neighbours whose class is settled
        change = np.zeros((size, size), np.int64)

        def settle(word: np.ndarray, code: np.ndarray) -> Iterator[pa.RecordBatch]:
            first = np.flatnonzero(np.concatenate([np.ones(min(1, len(word)), bool), word[1:] != word[:-1]]))
            sizes = np.diff(np.append(first, len(word)))
            classed = code[first] == -1
            keep = np.repeat(classed, sizes) & (code >= 0)
            group, code = np.repeat(np.cumsum(classed) - 1, sizes)[keep], code[keep]
            words = word[first[classed]]
            for i in range(0, len(words), 5000):
                own = slice(*np.searchsorted(group, [i, i + 5000]))
                g, c, m = group[own] - i, code[own].astype(np.int64), min(5000, len(words) - i)
                kind, before, after = c // (base * base), c // base % base, c % base
                cell = np.concatenate([g * width + np.where(after == size, 2 * size, after), (g * width + size + before)[before < size]])
                dense = np.bincount(cell, minlength=m * width).reshape(m, width)
                at = np.zeros(m, np.int64)
                at[g] = k + kind
                label = gains(joint, k, at, dense[:, :size].astype(float), dense[:, size:-1].astype(float), dense[:, -1].astype(float)).argmax(axis=1)
                for side, table in ((dense[:, :size], change), (dense[:, size:-1], change.T)):
                    for where, sign in ((label, 1), (at, -1)):
                        part = np.zeros((size, len(told)), np.int64)
                        np.add.at(part, where, side[:, told])
                        table[:, told] += sign * part
                yield pa.RecordBatch.from_arrays([pa.array(words[i : i + m]), pa.array(label.astype(np.int32)), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int64())], ["word", "label", "code", "n"])

        word, code = np.zeros(0, np.int64), np.zeros(0, np.int32)
        for batch in batches:
            word, code = np.append(word, batch.column(0).to_numpy()), np.append(code, batch.column(1).to_numpy())
            # the last word may go on in the next batch; it is seen less often than the cut
            last = int(np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))[-1]) if len(word) else 0
            yield from settle(word[:last], code[:last])
            word, code = word[last:], code[last:]
        yield from settle(word, code)
        a, b = np.nonzero(change)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(change[a, b])], ["word", "label", "code", "n"])

    return run


def move(joint: np.ndarray, k: int):
    """Best class of every word by its evidence, whose rows come sorted by word; a word's sums go on from batch to batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(joint)
        width = 2 * size + 1
        word, at, dense = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, width))

        def best() -> pa.RecordBatch:
            gain = gains(joint, k, at, dense[:, :size], dense[:, size:-1], dense[:, -1])
            top = gain.argmax(axis=1)
            each, stay = np.arange(len(at)), np.minimum(at, k - 1)
            top = np.where((at < k) & (gain[each, top] <= gain[each, stay] + 1e-9), at, top)
            return pa.RecordBatch.from_arrays([pa.array(word, pa.int64()), pa.array(top, pa.int32())], ["word", "label"])

        for batch in batches:
            for i in range(0, len(batch), 5000):
                part = batch.slice(i, 5000)
                codes = part.column(2)
                offsets = codes.offsets.to_numpy()
                code = codes.values.to_numpy()[offsets[0] : offsets[-1]]
                # the last word so far, then those of this part
                words, labels, sums = np.append(word, part.column(0).to_numpy()), np.append(at, part.column(1).to_numpy()), dense
                first = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]]))
                group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(words))))[len(word) :]
                cell = np.repeat(group, np.diff(offsets)) * width + (code >> COUNT)
                dense = np.bincount(cell, weights=code & ((1 << COUNT) - 1), minlength=len(first) * width).reshape(-1, width)
                dense[: len(sums)] += sums
                word, at = words[first], labels[first]
                rest = word[-1:], at[-1:], dense[-1:]
                if len(word) > 1:
                    word, at, dense = word[:-1], at[:-1], dense[:-1]
                    yield best()
                word, at, dense = rest
        if len(word):
            yield best()

    return run


class Model:
    """What a task needs to score: bounded tables."""

    def __init__(self, known: Known, cut: int, joint: np.ndarray, inside: np.ndarray, kinds: pd.DataFrame, classed: pd.DataFrame, ends: int):
        """inside: occurrences of each word class; kinds, classed: occurrences n and words v by length, of all words and of those in classes."""
        self.known, self.cut, self.ends = known, cut, ends
        each = joint.sum(axis=0)
        prior = (each + 1) / (each.sum() + len(joint))
        self.transition = np.log10((joint + KAPPA * prior) / (joint.sum(axis=1, keepdims=True) + KAPPA))
        n, v, less_n, less_v = np.zeros((4, LENGTHS))
        n[kinds["kind"]], v[kinds["kind"]] = kinds["n"], kinds["v"]
        less_n[classed["kind"]], less_v[classed["kind"]] = classed["n"], classed["v"]
        self.total, self.words = int(n.sum()) + ends, int(v.sum()) + (ends > 0)
        self.inside = np.log10(np.maximum(inside, 1))
        # length classes: without the words in classes, one more place for what was never seen
        self.rest = np.log10(n - less_n + v - less_v + 1)
        self.base = float(np.log10(self.total + self.words + 1))

    def emission(self, label: np.ndarray, kind: np.ndarray, n: np.ndarray) -> np.ndarray:
        in_class = label < self.known.k
        return np.where(in_class, np.log10(np.maximum(n, 1)) - self.inside[np.where(in_class, label, 0)], np.log10(n + 1) - self.rest[kind])


SCORED = "row long, doc_id long, held_out boolean, tokens long, known long, base double, score double"
PART = "row long, known long, base double, score double"


def score_docs(shared):
    """Per row what the bounded tables tell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        known, none = model.known, np.zeros(LENGTHS)
        size, labels = known.size, known.labels()
        kind = np.maximum(known.label - known.k, 0).clip(max=LENGTHS - 1)  # of words in no class, whose label is their length's
        each = known.of_codes(model.emission(known.label, kind, known.n), none, 0)
        base = known.of_codes(np.log10(known.n + 1) - model.base, none, np.log10(model.ends + 1) - model.base)
        here = known.of_codes(np.ones(len(known.word), bool), none, model.ends > 0)
        transition = model.transition.ravel()
        for rows, code, per in stretches(batches):
            label, own = labels[code], np.repeat(np.arange(len(per)), per)
            step = transition[label[:-1] * size + label[1:]]
            if known.some_rarer:
                rest = (code >= known.rest) & (code < known.edge)
                step[rest[:-1] | rest[1:]] = 0
            code = code[:-1]
            sums = [np.bincount(own, weights=w, minlength=len(per)) for w in (here[code], base[code], each[code] + step)]
            yield pa.RecordBatch.from_arrays([rows.column("row"), rows.column("doc_id"), rows.column("held_out"), pa.array(per), pa.array(sums[0].astype(np.int64)), *map(pa.array, sums[1:])], ["row", "doc_id", "held_out", "tokens", "known", "base", "score"])

    return run


RARE = "row long, word long, code int, tf long"


def rare_of_docs(shared):
    """Words that do not travel, by row; code: length, then the classes before and after to the base of size + 1, size where the transition is told elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value.known
        size, labels = known.size, known.labels()
        labels[known.rest : known.edge] = size
        if not known.some_rarer:
            labels[:] = size
        for rows, code, per in stretches(batches):
            at = np.flatnonzero((code >= known.rest) & (code < known.edge))
            word, _ = flat(rows.column("rare"), np.int64)
            codes = ((code[at] - known.rest) * (size + 1) + labels[code[at - 1]]) * (size + 1) + labels[code[at + 1]]
            keys, tf = tallied(np.stack([np.repeat(np.arange(len(per)), per)[at], word, codes]))
            row = rows.column("row").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(row[keys[0]]), pa.array(keys[1]), pa.array(keys[2].astype(np.int32)), pa.array(tf)], ["row", "word", "code", "tf"])

    return run


def filled(column: pa.Array, value: int) -> np.ndarray:
    return column.fill_null(value).to_numpy().astype(np.int64)


def score_rare(shared):
    """Scores of words that do not travel (n: their count, null if unseen; label: their class, null for the length's) and of the transitions around them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        k, size = model.known.k, model.known.size
        transition = np.zeros((size + 1, size + 1))
        transition[:size, :size] = model.transition
        for batch in batches:
            code, tf, n = (filled(batch.column(c), 0) for c in ("code", "tf", "n"))
            kind, before, after = code // (size + 1) ** 2, code // (size + 1) % (size + 1), code % (size + 1)
            label = filled(batch.column("label"), -1)
            label = np.where(label < 0, k + kind, label)
            each = model.emission(label, kind, n) + transition[before, label] + transition[label, after]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(np.where(n > 0, tf, 0)), pa.array((np.log10(n + 1) - model.base) * tf), pa.array(each * tf)], ["row", "known", "base", "score"])

    return run


def score_two(shared):
    """Transitions between two words that do not travel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            kinds, tf = filled(batch.column("kinds"), 0), filled(batch.column("tf"), 0)
            a, b = (np.where(own < 0, model.known.k + kind, own) for own, kind in ((filled(batch.column("l1"), -1), kinds // LENGTHS), (filled(batch.column("l2"), -1), kinds % LENGTHS)))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(np.zeros(len(tf), np.int64)), pa.array(np.zeros(len(tf))), pa.array(model.transition[a, b] * tf)], ["row", "known", "base", "score"])

    return run


def seeds(known: pd.DataFrame, top: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, int]:
    """Classes of the top words by exchange, and the number of classes; pairs: of top words, lengths and the edge."""
    ranked = known.sort_values(["n", "word"], ascending=[False, True])["word"].to_numpy()[:TOP]
    edge, t = TOP + LENGTHS, len(top)
    order = np.concatenate([lookup(top, ranked), np.arange(TOP, edge + 1)]).astype(int)  # symbols in order of falling frequency
    label = np.zeros(edge + 1, np.int64)
    label[order] = exchange(pairs[np.ix_(order, order)], t, CLASSES)
    return label[:t], min(CLASSES, max(1, t))


def fit(docs: DataFrame, scratch: Scratch) -> tuple[Model, DataFrame]:
    """Model, and word counts of the training documents (doc_id, text, held_out): word, kind, n, label (null below LEAST) of the words below the model's cut."""
    return fit_encoded(docs, scratch)[:2]


def fit_encoded(docs: DataFrame, scratch: Scratch) -> tuple[Model, DataFrame, DataFrame, DataFrame | None]:
    """As fit, and all documents encoded, and their pairs of words that do not travel with the classes of both (none where no such word has a class)."""
    spark = docs.sparkSession
    counts = docs.where("not held_out").select("text").mapInPandas(count_words, "word long, kind int, n long").groupBy("word").agg(F.min("kind").alias("kind"), F.sum("n").alias("n"))
    counts = scratch.table(counts, "counts")
    # the smallest cut that at most KNOWN words reach
    # (counts to ten bits, rounded down: a few thousand rows whatever the corpus)
    low = F.greatest(F.lit(0), F.length(F.bin("n")) - 10)
    rounded = F.call_function("shiftleft", F.call_function("shiftright", F.col("n"), low), low)
    sizes = counts.groupBy(rounded.alias("n")).agg(F.count("*").alias("v")).orderBy(F.desc("n")).collect()
    cut, reached = 1 << 62, 0
    for r in sizes:
        reached += r["v"]
        if reached > KNOWN:
            break
        cut = r["n"]
    some_rarer = any(LEAST <= r["n"] < cut for r in sizes)
    known = counts.where(F.col("n") >= cut).toPandas().sort_values("word")
    by_kind = lambda rows: rows.groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("v")).toPandas()
    kinds, classed = by_kind(counts), by_kind(counts.where(F.col("n") >= LEAST))
    words, n, kind = known["word"].to_numpy(), known["n"].to_numpy(), known["kind"].to_numpy().astype(np.int64)
    state = Known(words, n, kind, 0, some_rarer)
    shared = spark.sparkContext.broadcast(state)
    whole = scratch.table(docs.select("doc_id", "text", "held_out").mapInArrow(encode(shared), ENCODED), "encoded")
    training = whole.where("not held_out")
    texts = training.select("low", "high")
    top = np.sort(known.sort_values(["n", "word"], ascending=[False, True])["word"].to_numpy()[:TOP])
    at = lookup(top, words)
    symbols = state.of_codes(np.where(at >= 0, at, TOP + kind), TOP + np.arange(LENGTHS), TOP + LENGTHS).astype(np.int64)
    first, k = seeds(known, top, bigrams(texts, symbols, TOP + LENGTHS + 1))
    place = lookup(words, top)
    first_n = n[place] >= LEAST
    label = k + kind
    label[place[first_n]] = first[first_n]
    state = Known(words, n, label, k, some_rarer)
    size = state.size

    best = None
    for turn in range(SPREAD + 1):
        joint = bigrams(texts, state.labels(), size)
        if turn and (best is None or likelihood(joint) > best[0]):
            best = likelihood(joint), state, joint
        if turn == SPREAD:
            break
        shared = spark.sparkContext.broadcast(state)
        # a word's rows, one or more from every task, meet in order: none is held with all of its rows
        sorted_ = texts.mapInArrow(gather(shared), EVIDENCE).repartition("word").sortWithinPartitions("word")
        moved = sorted_.mapInArrow(move(joint, k), "word long, label int").toPandas()  # at most KNOWN rows
        label = state.label.copy()
        label[state.order[moved["word"].to_numpy()]] = moved["label"].to_numpy()
        state = Known(words, n, label, k, some_rarer)
    _, state, joint = best
    inside = np.bincount(state.label, weights=n, minlength=size)[:k]
    rare = counts.where(F.col("n") < cut)
    if not some_rarer:
        return Model(state, cut, joint, inside, kinds, classed, training.count()), rare.withColumn("label", F.lit(None).cast("int")), whole, None

    shared = spark.sparkContext.broadcast(state)
    rows = training.select("low", "high", "rare").mapInArrow(rare_words(shared), "word long, code int")
    rows = rows.unionByName(rare.where(F.col("n") >= LEAST).select("word", F.lit(-1).alias("code")))
    moved = scratch.table(rows.repartition("word").sortWithinPartitions("word", "code").mapInArrow(move_rare(joint, k), MOVED), "moved")
    for r in moved.where("word is null").groupBy("label", "code").agg(F.sum("n").alias("n")).collect():
        joint[r["label"], r["code"]] += r["n"]
    labels = moved.where("word is not null").select("word", "label")
    pairs = both(whole.select("row", "held_out", "low", "high", "rare").mapInArrow(rare_pairs(shared), PAIRS), labels)
    met = scratch.table(pairs.select("row", "held_out", "kinds", "l1", "l2", "tf"), "pairs")  # counted here, scored later
    pairs = met.where("not held_out").groupBy("kinds", "l1", "l2").agg(F.sum("tf").alias("n")).toPandas()
    lengths = k + pairs["kinds"].to_numpy() // LENGTHS, k + pairs["kinds"].to_numpy() % LENGTHS
    np.subtract.at(joint, lengths, pairs["n"].to_numpy())
    np.add.at(joint, tuple(pairs[f"l{s}"].fillna(pd.Series(at)).to_numpy().astype(int) for s, at in zip("12", lengths, strict=True)), pairs["n"].to_numpy())
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    rarer = rare.where(F.col("n") >= LEAST).select("*", none("int", "label")).unionByName(labels.select("word", none("int", "kind"), none("long", "n"), "label"))
    rarer = scratch.table(rarer.groupBy("word").agg(F.max("kind").alias("kind"), F.max("n").alias("n"), F.max("label").alias("label")), "rarer-counts")
    rare = rare.where(F.col("n") < LEAST).select("*", none("int", "label")).unionByName(rarer)
    for r in rarer.where("label is not null").groupBy("label").agg(F.sum("n").alias("n")).collect():
        inside[r["label"]] += r["n"]
    return Model(state, cut, joint, inside, kinds, classed, training.count()), rare, whole, met


def score(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of every document."""
    scratch = scratch or Scratch(docs.sparkSession, "brown")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("held_out", F.coalesce(remainder(MODULUS) == HOLDOUT, F.lit(False)))
    model, counts, whole, pairs = fit_encoded(docs, scratch)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    told = whole.select("row", "doc_id", "held_out", "low", "high").mapInArrow(score_docs(shared), SCORED)
    texts = whole.select("row", "low", "high", "rare")
    rare = texts.mapInArrow(rare_of_docs(shared), RARE).join(counts.select("word", "n", "label"), "word", "left")
    parts = rare.select("row", "code", "tf", "n", "label").mapInArrow(score_rare(shared), PART)
    if pairs is not None:
        parts = parts.unionByName(pairs.drop("held_out").mapInArrow(score_two(shared), PART))
    none = lambda kind: F.lit(None).cast(kind)
    out = told.unionByName(parts.select("row", none("long").alias("doc_id"), none("boolean").alias("held_out"), F.lit(0).cast("long").alias("tokens"), "known", "base", "score"))
    out = out.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.sum("tokens").alias("n_tokens"), F.sum("known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("score").alias("score"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read_table(spark, sf_dir, "documents"))
