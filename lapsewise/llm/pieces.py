"""N-best segmentation of texts into the pieces of a public SentencePiece vocabulary, and decoding.

A piece's score is the Zipf estimate of its log probability, -ln(rank + 2), rank being its place in the vocabulary; a
byte stands for what no piece covers. Forward Viterbi scores give, for every place of a text, the best score of the text
up to there. Used as the heuristic of a backward A* search over the piece lattice they are exact, so the search pops
complete segmentations in order of falling score, without detours.

No piece holds a blank mark after another character, or letters next to other characters, so the lattice falls apart
there, and nowhere else. The search runs once for each distinct word of a worker; the N best of a text are merged from those of its words by the same best-first
search over the words' next alternatives. Ties go to the longer last piece. Words of more than LONGEST characters take a
form of the search that keeps a score for each place and no lattice, so that time and memory follow their length.

Nulls: a null text is an empty one, without pieces; a null doc_id stays a row. Repeated rows give repeated rows. Extra
columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapsewise.llm.shared import blocks, read_table

N_BEST = 3
MARK = "▁"
#: Distinct words that a worker remembers; characters of the longest word whose lattice is held (and that is remembered).
REMEMBERED, LONGEST = 500_000, 200
_WORDS = re.compile(rf"{MARK}*(?:[^\W\d_²]+|(?:(?!{MARK})[\W\d_²])+)|{MARK}+")
_MIXED = re.compile(rf"[^\W\d_²](?:[\W\d_²])|(?!{MARK})[\W\d_²][^\W\d_²]")

Path = tuple[float, tuple[int, ...]]


class Vocabulary:
    def __init__(self, model: str):
        import public_tokenizers
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(model))
        self.text = [p.id_to_piece(i) for i in range(p.get_piece_size())]
        self.byte = {int(self.text[i][3:5], 16): i for i in range(len(self.text)) if p.is_byte(i)}
        plain = [i for i in range(len(self.text)) if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i))]
        self.score = {i: -math.log(rank + 2) for rank, i in enumerate(plain)}
        self.of = {self.text[i]: (i, self.score[i], (i,)) for i in plain}
        # a byte costs more than any piece
        self.byte_score = -math.log(len(plain) + 2) - 1
        self.bytes_of = {i: self.text[i].replace(MARK, " ").encode() for i in plain} | {i: bytes([b]) for b, i in self.byte.items()}
        if any(MARK in t.lstrip(MARK) or _MIXED.search(t) for t in self.of):
            raise ValueError("pieces run across words, or across letters and other characters")
        self.widest = max(map(len, self.of))
        self.known: dict[str, tuple] = {}
        #: the pieces by character: what may follow, and score and ids if a piece ends here
        self.tree: dict[str, tuple[dict, tuple | None]] = {}
        for text in sorted(self.of):  # a beginning comes before what it begins
            node = self.tree
            for k, character in enumerate(text, 1):
                if character not in node:
                    node[character] = {}, self.of.get(text[:k], ())[1:] or (self.spelt(character) if k == 1 else None)
                node = node[character][0]

    def first(self, character: str) -> tuple[dict, tuple]:
        """The node of a character that no piece begins with: it is spelt in bytes."""
        self.tree[character] = {}, self.spelt(character)
        return self.tree[character]

    def best_of_word(self, word: str) -> tuple[Path, ...]:
        """The N_BEST best segmentations of one word, best first."""
        n, begin = len(word), self.tree.get
        into: list[list] = [[] for _ in range(n + 1)]
        best = [0.0] + [-math.inf] * n
        for start, character in enumerate(word):  # forward: pieces by start, so that best[start] is final
            here, end = best[start], start + 1
            node, edge = begin(character) or self.first(character)
            while True:
                if edge:
                    score, ids = edge
                    into[end].append((start, score, ids))
                    if here + score > best[end]:
                        best[end] = here + score
                if end == n:
                    break
                found = node.get(word[end])
                if found is None:  # no piece starts like this
                    break
                node, edge = found
                end += 1
        out: list[Path] = []
        # backward: what is done plus the exact best of what is left in front. An open entry's best continuation has
        # the entry's own score, so it would be popped next: it is followed at once, and only its rivals are queued.
        # Every entry stands for other segmentations, so no more need to stay open than are still wanted.
        queue: list[tuple[float, tuple[int, ...], int, float]] = [(-best[n], (), n, 0.0)]
        while queue:
            _, ids, at, done = queue.pop(0)
            room = N_BEST - len(out) - 1
            while at:
                top, chosen = best[at], None
                for edge in into[at]:
                    whole = best[edge[0]] + edge[1]
                    if chosen is None and whole == top:
                        chosen = edge
                    elif room and (len(queue) < room or -whole - done < queue[-1][0]):
                        insort(queue, (-whole - done, edge[2] + ids, edge[0], edge[1] + done))
                        del queue[room:]
                at, score, own = chosen
                ids, done = own + ids, done + score
            out.append((done, ids))
            if not room:
                break
        return tuple(out)  # tuples throughout, which the garbage collector need not follow

    def spelt(self, character: str) -> tuple[float, tuple[int, ...]]:
        """Score and ids of a character in bytes."""
        raw = character.replace(MARK, " ").encode("utf-8", "surrogatepass")
        return len(raw) * self.byte_score, tuple(self.byte[b] for b in raw)

    def best_of_long_word(self, word: str) -> tuple[Path, ...]:
        """As best_of_word, over the same whole lattice: the edges into a place are looked up again when a path gets there."""
        n, look = len(word), self.of.get
        best = [0.0] + [-math.inf] * n
        for start, character in enumerate(word):
            node, edge = self.tree.get(character) or self.first(character)
            for end in range(start + 1, n + 1):
                if edge and best[start] + edge[0] > best[end]:
                    best[end] = best[start] + edge[0]
                found = node.get(word[end]) if end < n else None
                if found is None:
                    break
                node, edge = found
        out: list[Path] = []
        # what is done is a chain (ids, what follows), shared between paths; the count settles ties by age
        queue: list[tuple[float, int, tuple | None, int, float]] = [(-best[n], 0, None, n, 0.0)]
        made = 0
        while queue:
            _, _, chain, at, done = queue.pop(0)
            room = N_BEST - len(out) - 1
            while at:
                top, chosen = best[at], None
                for start in range(max(0, at - self.widest), at):
                    edge = look(word[start:at], ())[1:] or (self.spelt(word[start]) if start == at - 1 else None)
                    if not edge:
                        continue
                    whole = best[start] + edge[0]
                    if chosen is None and whole == top:
                        chosen = start, *edge
                    elif room and (len(queue) < room or -whole - done < queue[-1][0]):
                        made += 1
                        insort(queue, (-whole - done, made, (edge[1], chain), start, edge[0] + done))
                        del queue[room:]
                at, score, own = chosen
                chain, done = (own, chain), done + score
            ids: list[int] = []
            while chain:
                ids.extend(chain[0])
                chain = chain[1]
            out.append((done, tuple(ids)))
            if not room:
                break
        return tuple(out)

    def word(self, w: str) -> tuple[float, float, bytes, bytes, tuple[Path, ...]]:
        """Best score, loss of the second best, ids of the best as 32-bit words, what they spell, all alternatives."""
        found = self.known.get(w)
        if found is None:
            best = self.best_of_word(w) if len(w) <= LONGEST else self.best_of_long_word(w)
            ids = best[0][1]
            found = (best[0][0], best[0][0] - best[1][0] if len(best) > 1 else math.inf, np.array(ids, "<i4").tobytes(), self.spell(ids), best)
            if len(w) <= LONGEST and len(self.known) < REMEMBERED:
                self.known[w] = found
        return found

    def segment(self, text: str) -> tuple[list[float], list[bytes], bytes]:
        """Scores and ids (32-bit words) of the N_BEST best segmentations of a whole text, and what the best one spells."""
        if not text:
            return [0.0], [b""], b""
        get, word = self.known.get, self.word
        rows = [get(w) or word(w) for w in _WORDS.findall(MARK + text.replace(" ", MARK))]
        losses = np.fromiter([r[1] for r in rows], float, len(rows))
        few = np.argsort(losses, kind="stable")[:N_BEST] if len(rows) < 64 else np.argpartition(losses, N_BEST)[:N_BEST]
        few = [int(i) for i in sorted(few) if losses[i] < math.inf]
        best = math.fsum([r[0] for r in rows])
        parts = [r[2] for r in rows]
        scores, ids = [], []
        for loss, pick in self.choices([[x[0] for x in rows[i][4]] for i in few]):
            now = parts
            if pick:
                now = parts.copy()
                for j, m in pick:
                    now[few[j]] = np.array(rows[few[j]][4][m][1], "<i4").tobytes()
            scores.append(best - loss)
            ids.append(b"".join(now))
        return scores, ids, b"".join([r[3] for r in rows])[1:]

    @staticmethod
    def choices(scores: list[list[float]]) -> list[tuple[float, tuple[tuple[int, int], ...]]]:
        """The N_BEST smallest losses when one alternative is taken of each list, with the (list, alternative) changed."""
        queue: list[tuple[float, tuple[tuple[int, int], ...]]] = [(0.0, ())]
        seen, out = {()}, []
        while queue and len(out) < N_BEST:
            loss, pick = heapq.heappop(queue)
            out.append((loss, pick))
            for i, own in enumerate(scores):
                now = dict(pick)
                k = now.get(i, 0) + 1
                if k < len(own):
                    now[i] = k
                    new = tuple(sorted(now.items()))
                    if new not in seen:
                        seen.add(new)
                        heapq.heappush(queue, (math.fsum(scores[j][0] - scores[j][m] for j, m in new), new))
        return out

    def spell(self, ids: tuple[int, ...]) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])

    def decode(self, ids: tuple[int, ...] | list[int] | np.ndarray) -> str:
        return self.spell(ids).decode("utf-8", "surrogatepass")[1:]


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(model: str) -> Vocabulary:
    if model not in _LOADED:
        _LOADED[model] = Vocabulary(model)
    return _LOADED[model]


def segmenter(model: str, with_ids: bool):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = vocabulary(model)
        for frame in blocks(frames):
            rows = []
            for doc, text in zip(frame["doc_id"], frame["text"], strict=True):
                text = text or ""
                scores, ids, spelt = words.segment(text)
                # a blank mark in the text itself reads back as a blank
                same = spelt == text.replace(MARK, " ").encode("utf-8", "surrogatepass")
                crcs = [zlib.crc32(x) for x in ids]
                rows.append((doc, len(ids[0]) // 4, crcs[0], [round(x, 6) for x in scores], [len(x) // 4 for x in ids], crcs, same, *([[np.frombuffer(x, "<i4") for x in ids]] if with_ids else [])))
            yield pd.DataFrame(rows, columns=["doc_id", "n_pieces", "ids_crc32", "scores", "lengths", "crcs", "reads_back", *["ids"] * with_ids])

    return run


def encode(docs: DataFrame, with_ids: bool = True, model: str = "piece_bpe_32k.model") -> DataFrame:
    """Of each row: pieces and checksum of its best segmentation, scores, lengths, checksums (and ids) of the N best."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_pieces long, ids_crc32 long, scores array<double>, lengths array<long>, crcs array<long>, reads_back boolean"
    return docs.mapInPandas(segmenter(model, with_ids), schema + ", ids array<array<int>>" * with_ids)


def decode(rows: DataFrame, column: str = "ids", model: str = "piece_bpe_32k.model") -> DataFrame:
    """rows with decoded: the text of an array<int> column; null where it is null."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        return ids.map(lambda x: None if x is None else vocabulary(model).decode(x))

    return rows.withColumn("decoded", text(F.col(column)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(read_table(spark, sf_dir, "documents"), with_ids=False)
