"""Cases that once went wrong: each is a fault that was found, and stays found."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from lapsewise.llm import brown, fim, minhash, packing, pii, shared, vector_graph
from lapsewise.llm.shared import Scratch


def test_a_lazy_result_outlives_a_pipeline(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(40)
    lazy = minhash.near_duplicates(docs)
    with Scratch.collecting():
        inner = Scratch(spark, "inner")
        path = inner.table(docs.select("doc_id"), "t")._scratch_path
        assert spark.read.parquet(path).count() == 40
    assert lazy.count() == 40
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def test_a_pipeline_deletes_its_own_tables_only(spark, small, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("near", corpus_pipeline.near_duplicates), ("data", corpus_pipeline.personal_data)])
    docs = spark.read.parquet(f"{small}/documents.parquet")
    before = minhash.near_duplicates(docs)
    out = corpus_pipeline.run(spark, small)
    assert before.count() == docs.count() and 0 < out.count() <= docs.count()


def thue_morse(n):
    text = "a"
    while len(text) < n:
        text += text.translate(str.maketrans("ab", "ba"))
    return text


def test_words_that_a_sum_of_powers_confuses(spark):
    a = thue_morse(2048)
    b = a.translate(str.maketrans("ab", "ba"))
    hashes, per = shared.word_hashes([a.encode(), b.encode()])
    assert list(per) == [1, 1] and hashes[0] != hashes[1]
    assert len(set(brown.tokens_of([a.encode(), b.encode()])[0])) == 2
    docs = spark.createDataFrame([(1, a), (2, b), (3, a)], "doc_id long, text string")
    got = {r["doc_id"]: (r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs).collect()}
    assert got == {1: (1, True), 2: (2, True), 3: (1, False)}


def test_word_hashes_depend_on_the_word_alone():
    words = [b"a", b"ab", b"abcdefg", b"abcdefgh", b"abcdefghi", b"x" * 17, b"x" * 16, "é☃".encode(), b"a\0", b"a\0\0", b"\0" * 9, b"\0" * 8]
    alone = [int(shared.word_hashes([w])[0][0]) for w in words]
    together = shared.word_hashes([b"  ".join(words), b"", b" ".join(words[::-1])])
    assert len(set(alone)) == len(words) and list(together[1]) == [len(words), 0, len(words)]
    assert list(together[0][: len(words)]) == alone and list(together[0][len(words) :]) == alone[::-1]
    assert int(shared.word_hashes([b"ABC"])[0][0]) == int(shared.word_hashes([b"abc"])[0][0])


def test_documents_without_a_number_are_packed(spark):
    big = 2**60 + 1
    docs = spark.createDataFrame([(None, "a b"), (big, "c"), (None, "a b"), (big, "c")], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["length"]) for r in packing.pack(packing.pieces(docs)).collect())
    assert got == [(0, 3), (0, 3), (big, 2), (big, 2)]
    assert sorted(r["doc_id"] or 0 for r in fim.fill_in_middle(docs).collect()) == [0, 0, big, big]


def test_account_numbers_before_a_word_in_capitals(spark):
    number = "BE68 5390 0754 7034"
    texts = [f"{number} BANK", f"x {number} EUR 5", f"{number} bank", number, "BE68 5390 0754 7035 BANK", f"{number} {number}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [(x["start"], x["stop"], x["value"]) for x in r["pii"]] for r in pii.find(docs).collect()}
    assert got[0] == got[2] == got[3] == [(0, 19, number)] and got[1] == [(2, 21, number)] and got[4] == [] and got[5][0] == (0, 19, number)
    redacted = pii.redact(docs).where("doc_id = 0").first()["text"]
    assert redacted.endswith(" BANK") and "5390" not in redacted


def test_exact_comparison_where_every_breadth_misses(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(8, 12))
    x = [(centres[i % 8] + rng.normal(scale=0.03, size=12)).tolist() for i in range(300)]
    df = spark.createDataFrame([(i, v, i % 2) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    m = np.array(x) / np.linalg.norm(x, axis=1, keepdims=True)
    lab = np.arange(300) % 2
    link = (m @ m.T >= 0.98) & (lab[:, None] == lab[None, :]) & ~np.eye(300, dtype=bool)
    asked = []
    monkeypatch.setattr(vector_graph, "recall", lambda *a: asked.append(1) or 0.5)
    monkeypatch.setattr(vector_graph, "EXACT", 40)
    monkeypatch.setattr(vector_graph.exact_links, "__defaults__", (40,))
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vector_graph.near_vectors(df, breadths=vector_graph.BREADTHS[:1]).collect()}
    reach = link | np.eye(300, dtype=bool)
    for _ in range(9):
        reach = (reach.astype(int) @ reach.astype(int)) > 0
    assert asked == [1] and got == {i: (int(link[i].sum()), int(np.flatnonzero(reach[i]).min())) for i in range(300)}


def test_recall_counts_every_audited_vector(spark, monkeypatch):
    x = [[1.0, 0.001 * (i % 7)] for i in range(1200)]
    df = spark.createDataFrame([(i, v, 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    found = []
    whole = vector_graph.recall
    monkeypatch.setattr(vector_graph, "AUDIT", 5)
    monkeypatch.setattr(vector_graph, "recall", lambda *a: found.append(whole(*a)) or found[-1])
    out = vector_graph.near_vectors(df)
    assert found == [1.0] and out.agg(F.min("n_links")).first()[0] == 1199


def test_sum_index_has_every_combination_once():
    lengths, gap = [1, 2, 3, 5, 8, 9, 13], 16
    got = list(packing.SumIndex(lengths, 16).combinations(gap))
    singles = {(x,) for x in lengths if x == gap}
    pairs = {(x, y) for x in lengths for y in lengths if y <= x and x + y == gap}
    threes = {(x, y, z) for x in lengths for y in lengths for z in lengths if z <= y <= x and x + y + z == gap}
    assert len(got) == len(set(got)) and set(got) == singles | pairs | threes and (13, 3) in pairs and (9, 5, 2) in threes


def test_plan_uses_up_all_and_fills_what_can_be_filled():
    patterns = packing.plan({10: 3, 6: 4, 4: 4, 3: 2, 2: 1, 1: 2}, 10)
    used = {}
    for pattern, n in patterns:
        assert sum(pattern) <= 10 and n > 0
        for x in pattern:
            used[x] = used.get(x, 0) + n
    assert used == {10: 3, 6: 4, 4: 4, 3: 2, 2: 1, 1: 2}
    assert sum(n for _, n in patterns) == 8 and ((6, 4), 4) in patterns and ((10,), 3) in patterns
