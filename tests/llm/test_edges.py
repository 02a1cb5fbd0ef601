"""Every operator on documents: columns with the names used inside, repeated rows, and a text of a million characters."""

import hashlib

import pytest

from lapsewise.llm import brown, fim, langid, line_dedup, merkle, minhash, packing, pieces, pii, quality, suffix_dedup

#: Names that some operator uses inside.
NAMES = ("row", "whole", "kept", "removed", "spans", "pii", "part", "node", "key", "id", "place", "hits", "found", "score", "start", "stop", "length", "piece", "ids", "h", "i", "n", "g", "path", "leaf", "band", "component", "label", "words", "tokens", "n_words", "lang_pred")
LONG = "abcdefghi " * 100_000
ROWS = [(1, "the quick brown fox jumps over the lazy dog " * 9, "en", "s", 1), (1, "the quick brown fox jumps over the lazy dog " * 9, "en", "s", 1), (2, LONG, "en", "s", 1), (3, None, None, None, None), (None, "der schnelle braune fuchs " * 9, "de", "s", 1), (None, "der schnelle braune fuchs " * 9, "de", "s", 1)]


@pytest.fixture(scope="module")
def docs(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in NAMES)
    return spark.createDataFrame([(*r, *["x"] * len(NAMES)) for r in ROWS], schema)


def test_quality(spark, docs):
    out = quality.assess(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int"))
    rows = out.collect()
    assert len(rows) == 6 and [r["n_words"] for r in rows if r["doc_id"] == 1] == [81, 81] and next(r for r in rows if r["doc_id"] == 2)["n_repeat_words"] == 100_000


def test_language(docs):
    rows = langid.identify(docs, langid.train(docs)).collect()
    by = {}
    for r in rows:
        by.setdefault(r["row"]["text"], set()).add((r["lang_pred"], r["score"]))
    assert len(rows) == 6 and all(len(x) == 1 for x in by.values()) and by[None] == {("und", 0.0)} and rows[0]["row"]["spans"] == "x"


def test_personal_data(docs):
    assert pii.find(docs).count() == 6
    out = pii.redact(docs)
    assert out.columns == docs.columns and sorted(r["text"] or "" for r in out.collect()) == sorted(r[1] or "" for r in ROWS)


def test_language_model(docs):
    rows = brown.score(docs).collect()
    same = {r["score"] for r in rows if r["doc_id"] == 1}
    assert len(rows) == 6 and len(same) == 1 and next(r for r in rows if r["doc_id"] == 2)["n_tokens"] == 100_001


def test_pieces(docs):
    rows = pieces.encode(docs).collect()
    assert len(rows) == 6 and len({tuple(map(tuple, r["ids"])) for r in rows if r["doc_id"] == 1}) == 1


def test_packing(docs):
    rows = packing.pack(packing.pieces(docs)).collect()
    whole = {}
    for r in rows:
        whole.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in whole.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    assert sum(r["piece"] == 0 for r in rows) == 6


def test_suffixes(docs):
    rows = suffix_dedup.strip_repeats(docs).collect()
    assert len(rows) == 6 and all(r["row"]["removed"] == "x" for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r["row"]["text"], set()).add(bytes(r["kept"]))
    assert by[ROWS[0][1]] == {b""} and by[None] == {b""} and len(by[LONG]) == 1


def test_minhash(docs):
    rows = minhash.near_duplicates(docs).collect()
    assert len(rows) == 6 and {r["component_id"] for r in rows if r["doc_id"] == 1} == {1}


def test_lines(docs):
    rows = line_dedup.dedup_lines(docs, least_docs=2).collect()
    assert len(rows) == 6 and sorted(r["n_dropped"] for r in rows) == [0, 0, 1, 1, 1, 1] and all(r["row"]["place"] == "x" for r in rows)


def test_manifest(docs):
    rows = merkle.manifest(docs).collect()
    assert len(rows) == 6 and len({r["root"] for r in rows}) == 1 and len({r["leaf"] for r in rows}) == 4


def test_fill_in_middle(docs):
    rows = fim.fill_in_middle(docs).collect()
    want = sorted(hashlib.sha256((r[1] or "").encode()).hexdigest() for r in ROWS)
    assert sorted(r["restored_sha256"] for r in rows) == want and all(fim.restore(r["output"], r["form"]) in {x[1] or "" for x in ROWS} for r in rows)
