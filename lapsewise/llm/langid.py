"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the bytes of the whole text (lower case, white space as single blanks) in both directions and labels
every byte. A document's probability of a language is the mean over all its bytes. So that long texts are read in
parallel and memory stays bounded, a text is labelled in stretches of STRETCH bytes; on either side of a stretch the
network first reads CONTEXT bytes of the text around it (blanks beyond its ends), so that the states run across words
and across the ends of stretches.

It is trained here, in numpy, by STEPS steps of backpropagation through time, on a bounded sample of labelled rows:
WINDOWS windows of WINDOW characters (more where that gives fewer than ENOUGH windows in all), spread evenly over each of
about DOCS documents of each language (fewer where there are so many languages that DOCS of each would exceed ALL_DOCS). Gathering the sample takes a count by language and one scan; the
sample and the weights are all that the driver holds.

Nulls: a null or letterless text is "und" with score 0, as is every text when nothing is labelled; a null lang is no
label; a null doc_id stays a row and is held out of training. Ties go to the first language by name. Repeated rows give
repeated rows. Extra columns are carried unchanged, in row; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapsewise.llm.shared import blocks, read_table

HIDDEN, STRETCH, CONTEXT, GRAIN = 8, 512, 32, 32
DOCS, ALL_DOCS, WINDOWS, ENOUGH, WINDOW = 300, 60_000, 4, 5000, 72
STEPS, BATCH, RATE, SEED = 260, 192, 0.02, 11
#: Stretches that are read side by side.
TOGETHER = 1024
UNDETERMINED = "und"
_HALF = np.float32(0.5)


def squash(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|): where a recurrent network has a tangent; cheap, and its slope follows from its value."""
    return x / (1 + np.abs(x))


def slope(y: np.ndarray) -> np.ndarray:
    """Of squash, by its value."""
    return (1 - np.abs(y)) ** 2


class Direction:
    """A gated recurrent layer over bytes: update and reset gates, candidate state. Arrays run (time, unit, text)."""

    def __init__(self, rng: np.random.Generator):
        self.e = rng.normal(0, 0.3, (256, 3 * HIDDEN)).astype(np.float32)  # input weights and biases, by byte
        self.u = rng.normal(0, 0.3, (HIDDEN, 3 * HIDDEN)).astype(np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.e, self.u]

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, list]:
        """States after each of the bytes x (time, text), and what going back needs."""
        e, u = self.e.T, self.u.T
        h = np.zeros((HIDDEN, x.shape[1]), e.dtype)
        out, memory = np.empty((len(x), *h.shape), e.dtype), []
        for t in range(len(x)):
            a = e[:, x[t]]
            gates = _HALF * squash(a[: 2 * HIDDEN] + u[: 2 * HIDDEN] @ h) + _HALF
            z, r = gates[:HIDDEN], gates[HIDDEN:]
            c = squash(a[2 * HIDDEN :] + u[2 * HIDDEN :] @ (r * h))
            memory.append((h, z, r, c))
            h = h + z * (c - h)
            out[t] = h
        return out, memory

    def backward(self, x: np.ndarray, memory: list, grad: np.ndarray) -> list[np.ndarray]:
        """Gradients by going back through time; grad: of the loss by each state."""
        du, da = np.zeros_like(self.u), np.empty((len(x), 3 * HIDDEN, x.shape[1]), self.e.dtype)
        carried = np.zeros_like(grad[0])
        for t in range(len(x) - 1, -1, -1):
            h, z, r, c = memory[t]
            g = grad[t] + carried
            dc = g * z * slope(c)
            drh = self.u[:, 2 * HIDDEN :] @ dc
            da[t] = np.concatenate([g * (c - h) * _HALF * slope(2 * z - 1), drh * h * _HALF * slope(2 * r - 1), dc])
            du[:, : 2 * HIDDEN] += h @ da[t, : 2 * HIDDEN].T
            du[:, 2 * HIDDEN :] += (r * h) @ dc.T
            carried = g * (1 - z) + drh * r + self.u[:, : 2 * HIDDEN] @ da[t, : 2 * HIDDEN]
        at = x.ravel()
        return [np.stack([np.bincount(at, da[:, k].ravel(), 256) for k in range(3 * HIDDEN)], axis=1).astype(self.e.dtype), du]

    def states(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """As forward, one state after the other and in place: a state is overwritten by the next."""
        e, u = np.ascontiguousarray(self.e.T), np.ascontiguousarray(self.u.T)
        n = x.shape[1]
        h, held, c, size_c = (np.zeros((HIDDEN, n), np.float32) for _ in range(4))
        a, gates, size = np.empty((3 * HIDDEN, n), np.float32), np.empty((2 * HIDDEN, n), np.float32), np.empty((2 * HIDDEN, n), np.float32)
        for row in x:
            np.take(e, row, axis=1, out=a, mode="clip")
            np.matmul(u[: 2 * HIDDEN], h, out=gates)
            gates += a[: 2 * HIDDEN]
            np.abs(gates, out=size)
            size += 1
            gates /= size
            gates *= _HALF
            gates += _HALF
            np.multiply(gates[HIDDEN:], h, out=held)
            np.matmul(u[2 * HIDDEN :], held, out=c)
            c += a[2 * HIDDEN :]
            np.abs(c, out=size_c)
            size_c += 1
            c /= size_c
            c -= h
            c *= gates[:HIDDEN]
            h += c
            yield h


class Network:
    def __init__(self, languages: list[str], seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.there, self.back = Direction(rng), Direction(rng)
        self.w = rng.normal(0, 0.3, (2 * HIDDEN, len(languages))).astype(np.float32)
        self.b = np.zeros(len(languages), np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [*self.there.parameters(), *self.back.parameters(), self.w, self.b]

    def gradients(self, x: np.ndarray, label: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean loss over all bytes of x (texts, length) and its gradients."""
        x = np.ascontiguousarray(x.T)
        (f, mf), (b, mb) = self.there.forward(x), self.back.forward(x[::-1])
        h = np.concatenate([f, b[::-1]], axis=1)
        y = np.einsum("hl,thn->tln", self.w, h) + self.b[:, None]
        y = np.exp(y - y.max(axis=1, keepdims=True))
        d = y / y.sum(axis=1, keepdims=True)
        each = np.arange(x.shape[1])
        loss = -np.log(np.maximum(d[:, label, each], 1e-9)).sum() / x.size
        d[:, label, each] -= 1
        d /= x.size
        dh = np.einsum("hl,tln->thn", self.w, d)
        return float(loss), [*self.there.backward(x, mf, dh[:, :HIDDEN]), *self.back.backward(x[::-1], mb, dh[::-1, HIDDEN:]), np.einsum("thn,tln->hl", h, d), d.sum(axis=(0, 2))]

    def fit(self, texts: list[bytes], labels: np.ndarray) -> None:
        """Adam over batches of texts, cut and padded with blanks to one length."""
        rng = np.random.default_rng(SEED)
        x = np.frombuffer(b"".join(t[:WINDOW].ljust(WINDOW) for t in texts), np.uint8).reshape(len(texts), -1)
        params = self.parameters()
        m, v, order = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], np.empty(0, np.int64)
        for step in range(1, STEPS + 1):
            while len(order) < BATCH:
                order = np.concatenate([order, rng.permutation(len(x))])
            own, order = order[:BATCH], order[BATCH:]
            _, grads = self.gradients(x[own], labels[own])
            rate = RATE / (1 + 4 * step / STEPS)
            for p, g, a, b in zip(params, grads, m, v, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-7)

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """Sum over the bytes of each text of the probabilities of each language."""
        out = np.zeros((len(texts), len(self.languages)))
        size = np.array([len(t) for t in texts], np.int64)
        blank = b" " * (CONTEXT + STRETCH)
        raw = np.frombuffer(b"".join(x for t in texts for x in (blank[:CONTEXT], t, blank)), np.uint8)
        many = -(-size // STRETCH)
        of = np.repeat(np.arange(len(texts)), many)
        place = (np.arange(len(of)) - (np.cumsum(many) - many)[of]) * STRETCH
        own = np.minimum(STRETCH, size[of] - place)
        first = (np.cumsum(size + len(blank) + CONTEXT) - (size + len(blank) + CONTEXT))[of] + place  # where the context begins
        grain = -(-own // GRAIN) * GRAIN
        for n in np.unique(grain):
            rows = np.flatnonzero(grain == n)
            for i in range(0, len(rows), TOGETHER):
                part = rows[i : i + TOGETHER]
                x = np.ascontiguousarray(raw[first[part] + np.arange(n + 2 * CONTEXT)[:, None]])
                np.add.at(out, of[part], self.stretches(x, own[part]))
        return out

    def stretches(self, x: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Summed probabilities over the first own bytes after the context of each column of x."""
        wf, wb, bias = np.ascontiguousarray(self.w[:HIDDEN].T), np.ascontiguousarray(self.w[HIDDEN:].T), self.b[:, None]
        n = len(x) - 2 * CONTEXT
        front = np.empty((n, len(bias), x.shape[1]), np.float32)
        for t, h in enumerate(self.there.states(x[: n + CONTEXT]), -CONTEXT):
            if t >= 0:
                np.matmul(wf, h, out=front[t])
        total = np.zeros(front.shape[1:], np.float32)
        for t, h in zip(range(n + CONTEXT - 1, -1, -1), self.back.states(x[CONTEXT:][::-1]), strict=True):
            if t < n:
                y = wb @ h
                y += front[t]
                y += bias
                y -= y.max(axis=0)
                np.exp(y, out=y)
                y *= (t < own) / y.sum(axis=0)
                total += y
        return total.T


def remainder(modulus: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus))


def plain(text: str) -> bytes:
    return " ".join(text.lower().split()).encode("utf-8", "surrogatepass")


def training_windows(docs: DataFrame) -> tuple[list[bytes], np.ndarray, list[str]]:
    """Windows, label numbers and languages of the bounded sample."""
    rows = docs.where(F.col("lang").isNotNull() & (remainder(3) != 1) & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    if not counts:
        return [], np.empty(0, np.int64), []
    most = max(1, min(DOCS, ALL_DOCS // len(counts)))
    share = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, most / n))])
    picked = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))
    windows = max(WINDOWS, -(-ENOUGH // sum(min(n, most) for n in counts.values())))
    step = F.greatest(F.lit(WINDOW), F.floor(F.length("text") / windows)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.lit(windows - 1)), lambda i: F.substring(F.col("text"), i * step + 1, F.lit(WINDOW)))
    found = picked.select("lang", "doc_id", cut.alias("cut")).orderBy("doc_id").limit(2 * most * len(counts)).collect()
    languages = sorted({r["lang"] for r in found})
    pairs = sorted({(w, r["lang"]) for r in found for x in r["cut"] if (w := plain(x))})
    order = {x: i for i, x in enumerate(languages)}
    return [w for w, _ in pairs], np.array([order[x] for _, x in pairs], np.int64), languages


def train(docs: DataFrame) -> Network | None:
    windows, labels, languages = training_windows(docs)
    if not windows:
        return None
    net = Network(languages)
    net.fit(windows, labels)
    return net


_LETTER = regex.compile(r"\p{L}")


def label(net: Network, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    lang, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
    some = [i for i, t in enumerate(texts) if t and _LETTER.search(t)]
    if some:
        read = [plain(texts[i]) for i in some]
        p = net.pooled(read) / np.array([len(t) for t in read])[:, None]
        for i, row in zip(some, p, strict=True):
            best = int(row.argmax())
            lang[i], score[i] = net.languages[best], min(1.0, float(row[best]))
    return lang, score


def identify(docs: DataFrame, net: Network | None) -> DataFrame:
    """row (all columns of docs, as a struct), lang_pred and score of every row's text. Only the text goes to Python."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").cast("string").alias("whole"))
    if net is None:
        return rows.select("row", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))

    @F.pandas_udf("lang_pred string, score double")
    def labelled(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = [label(net, [None if t is None else t for t in part["text"]]) for part in blocks(iter([pd.DataFrame({"text": batch})]))]
            yield pd.DataFrame({"lang_pred": [x for lang, _ in parts for x in lang], "score": [x for _, score in parts for x in score]})

    return rows.select("row", labelled("whole").alias("found")).select("row", "found.lang_pred", "found.score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    out = identify(docs.select("doc_id", "text"), train(docs)).select("row.doc_id", "lang_pred", "score")
    return out.select("doc_id", F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
