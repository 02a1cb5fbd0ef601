"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing extra columns, for every operator."""

import pytest

from lapsewise.llm import brown, chat, langid, minhash, packing, pieces, pii, quality, suffix_dedup, vector_graph

LONG = "word " * 3000
DOCS = [(1, "the cat sat on the mat " * 12, "en", "s", 1, "x"), (2, None, None, None, None, None), (3, "", "en", "s", 0, "x"), (4, LONG, "en", "s", 1, "x"), (5, "der hund lief in den wald " * 12, "de", "s", 1, "x"), (6, "der hund lief in den wald " * 12, "de", "s", 1, "x"), (7, "é ☃ \t\n", None, "s", 1, "x")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(1, 1), (5, 0)], "doc_id long, quality int")
    r = by_id(quality.assess(docs, labels))
    assert r[2]["base_failed"] and not r[2]["kept"] and r[3]["n_words"] == 0 and r[4]["n_repeat_words"] == 3000
    assert quality.assess(none, labels).count() == 0


def test_language(docs, none):
    net = langid.train(docs)
    r = by_id(langid.identify(docs, net).select("row.doc_id", "lang_pred", "score"))
    assert r[2]["lang_pred"] == r[3]["lang_pred"] == "und" and r[5]["lang_pred"] == r[6]["lang_pred"] and 0 <= r[4]["score"] <= 1
    assert langid.train(none) is None and langid.identify(none, None).count() == 0
    assert langid.label(net, ["²½ 3", "é"])[0][0] == "und"


def test_pii(docs, none):
    r = by_id(pii.find(docs))
    assert r[2]["pii"] == [] and r[4]["pii"] == []
    assert by_id(pii.redact(docs))[2]["text"] is None and pii.find(none).count() == 0


def test_brown(docs, none):
    r = by_id(brown.score(docs))
    assert r[2]["n_tokens"] == r[3]["n_tokens"] == 1 and all(x["score"] < 0 for x in r.values())
    assert brown.score(none).count() == 0


def test_chat(spark):
    rows = [(1, 0, "user", None, "x"), (1, None, "user", "first", "x"), (1, 1, None, "?", "x"), (None, 0, "user", "gone", "x"), (2, 0, "assistant", "a", "x"), (2, 0, "assistant", "a", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    r = {x["conv_id"]: x for x in chat.format_chats(df).collect()}
    assert set(r) == {1, 2} and r[2]["formatted"] == "<s>a<|turn|>a</s>" and len(r[2]["loss_spans"]) == 2
    assert chat.format_chats(df.limit(0)).count() == 0


def test_pieces(docs, none):
    r = by_id(pieces.decode(pieces.encode(docs).selectExpr("*", "ids[0] as best"), "best"))
    assert r[2]["n_pieces"] == 0 and r[4]["decoded"] == LONG and r[7]["decoded"] == DOCS[6][1] and all(x["reads_back"] for x in r.values())
    assert pieces.encode(none).count() == 0


def test_packing(docs, none):
    rows = packing.pack(packing.pieces(docs)).collect()
    of = {r["doc_id"]: [x for x in rows if x["doc_id"] == r["doc_id"]] for r in rows}
    assert len(of[2]) == len(of[3]) == 1 and of[2][0]["length"] == 1
    assert sorted(x["length"] for x in of[4])[1:] == [1024] * (len(of[4]) - 1)
    assert packing.pack(packing.pieces(none)).count() == 0


def test_suffix(docs, none):
    r = by_id(suffix_dedup.strip_repeats(docs).select("row.*", "kept", "removed"))
    assert r[2]["kept"] == b"" and r[5]["kept"] != r[5]["removed"] and len(r[4]["kept"]) < 210
    assert suffix_dedup.strip_repeats(none).count() == 0


def test_minhash(docs, none):
    r = by_id(minhash.near_duplicates(docs))
    assert r[6]["component_id"] == 5 and not r[6]["kept"] and r[2]["component_id"] == 2 and r[3]["n_shingles"] == 0
    assert minhash.near_duplicates(none).count() == 0


def test_vectors(spark):
    rows = [(1, [1.0, 0.0], 0, "x"), (2, [1.0, 0.05], 0, "x"), (3, [1.0, 0.0], 0, "x"), (4, None, 0, "x"), (5, [0.0, 0.0], 0, "x"), (6, [1.0, None], 0, "x"), (7, [1.0, 0.0], None, "x"), (8, [float("nan"), 1.0], 0, "x"), (9, [1.0, 0.0], 1, "x"), (10, [1.0, 0.0, 0.0], 0, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, component_id string")
    r = {x["vec_id"]: x for x in vector_graph.near_vectors(df).collect()}
    assert [r[i]["n_links"] for i in range(1, 11)] == [2, 2, 2, 0, 0, 0, 0, 0, 0, 0] and r[3]["component_id"] == 1 and len(r) == 10
    assert vector_graph.near_vectors(df.limit(0)).count() == 0
