"""Fill-in-the-middle: a text's lines are parted in prefix, middle and suffix, and put in another order between marks.

Which lines go where, and which form a document takes, follows from a hash of seed and doc_id. The parts leave their
row as pieces of at most CHUNK characters, cut at line ends where there is one, keyed by document and place in the
output. A secondary sort (repartition by document, sortWithinPartitions by document and place: the DataFrame form of
repartitionAndSortWithinPartitions, whose memory and spills are Spark's own) brings the pieces of a document together
in output order; they stream through a digest of the output one by one. For the way back the marks are found again in
that stream, the pieces between them are sorted by their place in the text, and stream through a second digest.

A document's key is its input partition and its number there, so rows with equal doc_id, repeated rows and rows
without doc_id (hashed as an empty number) stay apart; ties do not arise. A task that is run again must find its rows in
the same order, as the tasks of a stored table do: write what comes from a shuffle first. Null texts are empty; an empty text, and one
that contains a mark, stays plain. No task holds more than the pieces of one document besides what the sort spills.
Extra columns are ignored, empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from lapsewise.llm.shared import blocks, read_table

SEED, RATE, SPM_RATE = 7, 100, 50
#: Marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Place of the part behind a mark in the text.
PLACE = {PREFIX.encode(): 0, MIDDLE.encode(): 1, SUFFIX.encode(): 2}
#: Characters of a piece at most.
CHUNK = 65_536
COLUMNS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string, restored_sha256 string"

#: The rows between the two steps: pieces, and before them at place -1 what is known of the document.
PIECES = "split int, k long, place int, piece binary, doc_id string, n long, form string, prefix_chars long, middle_chars long"
#: Characters and documents after which a task hands results on.
HAND_ON = (2_000_000, 1000)


def cut(part: str, chunk: int) -> Iterator[str]:
    """part in pieces of at most chunk characters that end with a line where they can."""
    at = 0
    while at < len(part):
        end = at + chunk
        if end < len(part):
            end = part.rfind("\n", at, end) + 1 or end
        yield part[at:end]
        at = end


def parted(doc_id: int | None, text: str, seed: int, rate: int, spm_rate: int) -> tuple[int, str, list[str]]:
    """Number of lines, form, and prefix, middle and suffix (all in the first where the form is plain)."""
    lines = text.split("\n")
    n = len(lines) - (lines[-1] == "")
    found = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(found[8 * i : 8 * i + 8], 16) for i in range(4))
    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= rate:
        return n, "plain", [text]
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    first = min(len(text), sum(len(x) + 1 for x in lines[:a]))
    last = min(len(text), first + sum(len(x) + 1 for x in lines[a:b]))
    return n, "spm" if h4 % 100 < spm_rate else "psm", [text[:first], text[first:last], text[last:]]


def pieces_of(seed: int, rate: int, spm_rate: int, chunk: int):
    def pieces(split: int, k: int, doc_id: int | None, text: str) -> Iterator[tuple]:
        n, form, parts = parted(doc_id, text, seed, rate, spm_rate)
        yield (split, k, -1, b"", None if doc_id is None else str(doc_id), n, form, *((len(parts[0]), len(parts[1])) if form != "plain" else (None, None)))
        if form == "plain":
            order = [("", parts[0])]
        else:
            order = [(PREFIX, parts[0]), (SUFFIX, parts[2]), (MIDDLE, parts[1])]
            order = [order[1], order[0], order[2]] if form == "spm" else order
        place = 0
        for mark, part in order:
            for piece in ([mark] if mark else []) + list(cut(part, chunk)):
                yield (split, k, place, piece.encode("utf-8", "surrogatepass"), None, None, None, None, None)
                place += 1

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        split, k = TaskContext.get().partitionId(), 0
        for frame in blocks(frames):
            rows = []
            for doc_id, text in zip(frame["doc_id"], frame["text"], strict=True):
                rows += pieces(split, k, int(doc_id) if isinstance(doc_id, str) else None, text or "")
                k += 1
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PIECES.split(", ")], dtype=object)

    return run


def documents(frames: Iterator[pd.DataFrame], with_output: bool) -> Iterator[tuple]:
    """One result for each document of a stream of sorted pieces, whatever batches they come in."""
    rows = (row for frame in frames for row in frame.itertuples(index=False, name=None))
    for _, own in groupby(rows, key=lambda p: p[:2]):
        _, _, _, _, doc_id, n, form, prefix_chars, middle_chars = next(own)
        forth, back = hashlib.sha256(), hashlib.sha256()
        output: list[bytes] = []
        found: list[tuple[int, int, bytes]] = []
        part = 0
        for _, _, place, piece, *_ in own:
            forth.update(piece)
            if with_output:
                output.append(piece)
            if form == "plain":
                back.update(piece)
            elif piece in PLACE:  # a text with a mark in it is plain
                part = PLACE[piece]
            else:
                found.append((part, place, piece))
        for _, _, piece in sorted(found, key=lambda x: x[:2]):
            back.update(piece)
        whole = b"".join(output).decode("utf-8", "surrogatepass") if with_output else None
        yield (*(None if pd.isna(x) else int(x) for x in (doc_id, n)), form, *(None if pd.isna(x) else int(x) for x in (prefix_chars, middle_chars)), whole, forth.hexdigest(), back.hexdigest())


def assembled(with_output: bool):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, size = [], 0
        names = [c.split()[0] for c in COLUMNS.split(", ")]
        for row in documents(frames, with_output):
            out.append(row)
            size += len(row[5] or "")
            if size > HAND_ON[0] or len(out) == HAND_ON[1]:
                yield pd.DataFrame(out, columns=names, dtype=object)
                out, size = [], 0
        if out:
            yield pd.DataFrame(out, columns=names, dtype=object)

    return run


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, with_output: bool = True, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n (lines), form, prefix_chars, middle_chars, output (null unless asked for), and the digests of the output and of the text restored from it."""
    # ids travel as text: a null among numbers would turn them into floating ones
    rows = docs.select(docs["doc_id"].cast("long").cast("string").alias("doc_id"), docs["text"].cast("string").alias("text"))
    pieces = rows.mapInPandas(pieces_of(seed, rate, spm_rate, chunk), PIECES)
    dealt = pieces.repartition("split", "k").sortWithinPartitions("split", "k", "place")
    return dealt.mapInPandas(assembled(with_output), COLUMNS)


def restore(output: str, form: str) -> str:
    """The text behind an output."""
    if form == "plain":
        return output
    head, middle = output.split(MIDDLE)
    if form == "psm":
        prefix, suffix = head[len(PREFIX) :].split(SUFFIX)
    else:
        suffix, prefix = head[len(SUFFIX) :].split(PREFIX)
    return prefix + middle + suffix


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle(read_table(spark, sf_dir, "documents"), with_output=False).drop("output")


SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256(concat('{SEED}:', doc_id)) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u, [('0x' || h[8 * i + 1 : 8 * i + 8])::BIGINT FOR i IN [0, 1, 2, 3]] AS hs FROM d),
c AS (SELECT *, len(u) AS n, least(hs[1] % (len(u) + 1), hs[2] % (len(u) + 1)) AS a, greatest(hs[1] % (len(u) + 1), hs[2] % (len(u) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR hs[3] % 100 >= {RATE} THEN 'plain' WHEN hs[4] % 100 < {SPM_RATE} THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(u[1 : a], '') AS p, array_to_string(u[a + 1 : b], '') AS m, array_to_string(u[b + 1 : n], '') AS s FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
"""
