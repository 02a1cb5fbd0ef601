"""Operators against brute force, round trips and held-out accuracy on small tables."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lapsewise.llm import brown, chat, langid, minhash, packing, pieces, pii, quality, suffix_dedup, vector_graph


def table(spark, small, name="documents"):
    return spark.read.parquet(f"{small}/{name}.parquet")


def test_repeated_strings_by_brute_force(spark, small):
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.query(spark, small).collect()}
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in table(spark, small).collect()}
    assert got == suffix_dedup.brute_force(texts)


def test_no_block_gets_many_rows_of_a_key(spark, monkeypatch):
    """A passage of most documents, with a field of few values near its edge and other text around."""
    monkeypatch.setattr(suffix_dedup, "LARGE_KEY", 4)
    most, expand = 4 * suffix_dedup.STRIDE, suffix_dedup.repeats_in_block

    def checked(frame):
        if frame.groupby("key").size().max() > most:
            raise ValueError("too many rows of one key")
        return expand(frame)

    monkeypatch.setattr(suffix_dedup, "repeats_in_block", checked)
    rng = random.Random(12)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    passages = [(noise(215), noise(tail)) for tail in (4, 7, 10, 13) for _ in range(3)]
    texts = {i: "".join(noise(60) + a + f"{2000 + i % 3}" + b for a, b in passages).encode() for i in range(150)}
    docs = spark.createDataFrame([(i, t.decode()) for i, t in texts.items()], "doc_id long, text string")
    got = {r["row"]["doc_id"]: sorted((x["start"], x["stop"]) for x in r["removed"]) for r in suffix_dedup.strip_repeats(docs).collect()}
    want = suffix_dedup.brute_force(texts)
    assert {d: (sum(b - a for a, b in x), len(x)) for d, x in got.items()} == {d: x[1:3] for d, x in want.items()}


def test_interval_expansion_on_random_strings():
    rng = random.Random(2)
    for minimum in (3, 6, 15):
        contexts = [bytes(rng.choice(b"ab\0") for _ in range(rng.randint(minimum, 60))) for _ in range(12)]
        symbol, order = suffix_dedup.transform(contexts)
        text = symbol.tobytes()
        word = symbol.itemsize
        got = suffix_dedup.repeated_suffixes(symbol, order, minimum)
        cut = lambda i: text[word * i : word * (i + minimum)]  # noqa: E731, B023
        for j in range(1, len(order)):
            a, b = order[j - 1], order[j]
            whole = [(symbol[i : i + minimum] > 0).all() for i in (a, b)]  # strings over a terminator are none
            if max(a, b) + minimum <= len(symbol) and any(whole):
                assert got[j] == (cut(a) == cut(b))


def test_large_keys_are_divided_without_loss(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "LARGE_KEY", 3)
    rng = random.Random(4)
    w = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = w(230)
    texts = {i: w(rng.randint(0, 120)) + passage[: rng.randint(150, 230)] + (passage[-40:] if i % 3 else "") + w(rng.randint(0, 120)) for i in range(40)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["row"]["doc_id"]: (r["n_bytes"], sum(x["stop"] - x["start"] for x in r["removed"]), hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in suffix_dedup.strip_repeats(df).collect()}
    want = {k: (v[0], v[1], v[3]) for k, v in suffix_dedup.brute_force({k: v.encode() for k, v in texts.items()}).items()}
    assert got == want


def test_near_duplicates_by_brute_force(spark):
    rng = random.Random(7)
    base = [[rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randint(1, 3) for _ in range(60)] for _ in range(6)]
    texts = {}
    for i in range(60):
        t = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            t[rng.randrange(len(t))] = "zz" + str(rng.randint(0, 9))
        texts[i] = " ".join(t)
    shingles = {i: {tuple(t.split()[k : k + 5]) for k in range(56)} for i, t in texts.items()}
    comp = {i: i for i in texts}
    changed = True
    while changed:
        changed = False
        for a in texts:
            for b in texts:
                k = len(shingles[a] & shingles[b])
                if 100 * k >= 75 * (len(shingles[a]) + len(shingles[b]) - k) and comp[a] != comp[b]:
                    comp[a] = comp[b] = min(comp[a], comp[b])
                    changed = True
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == comp


def components_by_brute_force(texts):
    """Smallest id reachable, by comparing all pairs; ids are those of the dict."""
    sets = {}
    for i, t in texts.items():
        w = t.split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    comp = {i: i for i in texts}
    links = [(a, b) for a in texts for b in texts if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if comp[a] != comp[b]:
                comp[a] = comp[b] = min(comp[a], comp[b])
                changed = True
    return comp


@pytest.mark.parametrize("asking", [1024, 7])
def test_groups_about_the_threshold(spark, monkeypatch, asking):
    """A large group whose pairs lie about the threshold, in one cell and in many: no link is lost."""
    monkeypatch.setattr(minhash, "ASKING", asking)
    monkeypatch.setattr(minhash, "ASKED", 2 * asking)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(200)]
    texts = {}
    for i in range(120):
        t = list(base)
        for k in rng.sample(range(200), rng.choice([0, 2, 4, 5, 6])):
            t[k] = f"x{rng.randint(0, 10**6)}"
        texts[i] = " ".join(t)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)).collect()}
    assert got == components_by_brute_force(texts)


def test_shared_ids_and_rows_without_id(spark):
    """Equal ids with other texts are documents of their own; rows without id link with their likes."""
    w = lambda c: " ".join(f"{c}{i}" for i in range(30))
    rows = [(1, w("a")), (1, w("b")), (5, w("a")), (3, w("b")), (None, w("b")), (None, w("c")), (None, w("c")), (7, w("d")), (7, w("d")), (8, None), (None, "")]
    got = sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    want = [("1", "1", True), ("1", "1", True), ("5", "1", False), ("3", "1", False), ("None", "1", False), ("None", "None", True), ("None", "None", True), ("7", "7", True), ("7", "7", True), ("8", "8", True), ("None", "None", True)]
    assert got == sorted(want)


def test_search_ends_where_a_beam_would_cycle():
    """200 vectors about 100 centres: a beam that forgets what it has visited goes round for ever here."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(100, 128))
    x = np.repeat(centres, 2, axis=0) + rng.normal(scale=0.1, size=(200, 128))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    frame = pd.DataFrame({"node": np.arange(200), "unit": [v.tobytes() for v in x], "label": 0, "bytes": 1024, "shard": 0})
    lists = vector_graph.builder(0.93)(frame)
    frame = frame.merge(lists, on="node").assign(copies=1, bridges=[[] for _ in range(200)])
    side = vector_graph.Side(frame)
    hits, _ = vector_graph.looked_for(side, side, vector_graph.BREADTHS[0])
    assert ((x @ x.T >= 0.98) == hits).all()


def test_vectors_of_a_dense_group_over_many_shards(spark, monkeypatch):
    monkeypatch.setattr(vector_graph, "SHARD", 60)
    monkeypatch.setattr(vector_graph, "LARGE", 150)
    rng = np.random.default_rng(6)
    x = rng.normal(size=32) + rng.normal(scale=0.11, size=(400, 32))
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int").repartition(4)
    got = {r["vec_id"]: r["n_links"] for r in vector_graph.near_vectors(df).collect()}
    m = x / np.linalg.norm(x, axis=1, keepdims=True)
    true = (m @ m.T >= 0.98).sum(axis=1) - 1
    assert all(got[i] <= true[i] for i in got) and sum(got.values()) >= 0.9 * true.sum() and true.sum() > 5000


def test_vectors_against_all_pairs_and_recall(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 16))
    x = [(centres[i % 30] + rng.normal(scale=0.04, size=16)).tolist() for i in range(600)] + [centres[0].tolist()] * 50
    df = spark.createDataFrame([(i, v, i % 2) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    out = vector_graph.near_vectors(df)
    m = np.array(x)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    lab = np.arange(len(x)) % 2
    link = (m @ m.T >= 0.98) & (lab[:, None] == lab[None, :]) & ~np.eye(len(x), dtype=bool)
    got = {r["vec_id"]: r["n_links"] for r in out.collect()}
    true = link.sum(axis=1)
    assert all(got[i] <= true[i] for i in got) and sum(got.values()) >= 0.95 * true.sum()
    found, there = vector_graph.audit_recall(df, out)
    assert there and found >= 0.9 * there


def test_packing_fills_exactly_and_ids_agree(spark, small):
    import public_tokenizers
    from tokenizers import Tokenizer

    rows = packing.query(spark, small).collect()
    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    of = {}
    for r in rows:
        of.setdefault(r["sequence_id"], []).append(r)
    for own in of.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == list(np.cumsum([0] + [r["length"] for r in own])[:-1]) and sum(r["length"] for r in own) <= 1024
    assert len(of) <= math.ceil(sum(r["length"] for r in rows) / 1024) * 1.02 + 2
    pieces_ = {(r["doc_id"], r["piece"]): r for r in rows}
    for r in table(spark, small).collect():
        ids = np.array([*tk.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        at = k = 0
        while at < len(ids):
            p = pieces_.pop((r["doc_id"], k))
            assert (p["start"], p["ids_crc32"]) == (at, zlib.crc32(ids[at : at + p["length"]].tobytes()))
            at, k = at + p["length"], k + 1
    assert not pieces_


def test_chunks_encode_like_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    encode, tk = packing.ChunkEncoder("byte_bpe_50k.json", "byte_bpe_50k.tiktoken"), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(5)
    for _ in range(300):
        t = "".join(rng.choice(["a", "the", " ", "  ", "\n", "é", "1", "'s", ".", "\t", " ", "☃", "<|endoftext|>"]) for _ in range(rng.randint(0, 12)))
        assert np.frombuffer(encode(t), "<u4").tolist() == tk.encode(t, add_special_tokens=False).ids, repr(t)


def test_plan_prefers_exact_complements():
    assert sorted(sorted(p) for p, _ in packing.plan({600: 2, 424: 1, 300: 1, 124: 1})) == [[124, 300, 600], [424, 600]]
    rng = random.Random(1)
    counts = {rng.randint(1, 1024): rng.randint(1, 50) for _ in range(200)}
    used = Counter()
    for pattern, n in packing.plan(counts):
        assert sum(pattern) <= 1024
        for x in pattern:
            used[x] += n
    assert used == Counter(counts)


def test_language_on_held_out_rows(spark, small):
    got = langid.query(spark, small).where("held_out").join(table(spark, small).select("doc_id", "lang"), "doc_id")
    assert got.where("lang = lang_pred").count() >= 0.95 * got.count()


def test_gradients_of_the_network():
    net = langid.Network(["a", "b", "c"])
    x, y = np.array([[65, 66, 67], [70, 66, 90]], np.uint8), np.array([0, 2])
    for direction in (net.there, net.back):
        direction.e, direction.u = direction.e.astype(np.float64), direction.u.astype(np.float64)
    _, grads = net.gradients(x, y)
    for p, g in zip(net.parameters(), grads, strict=True):
        i = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, h = p[i], 1e-2
        p[i] = old + h
        up = net.gradients(x, y)[0]
        p[i] = old - h
        down = net.gradients(x, y)[0]
        p[i] = old
        assert (up - down) / (2 * h) == pytest.approx(g[i], rel=0.05, abs=1e-4)


def test_base_scores_and_classes(spark, small):
    texts = {r["doc_id"]: (r["text"] or "").encode().lower().split() for r in table(spark, small).collect()}
    train = [w for i, w in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(x for w in train for x in w)
    n, v, ends = sum(c.values()) + len(train), len(c) + 1, len(train)
    for r in brown.query(spark, small).collect():
        w = texts[r["doc_id"]]
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w) + math.log10((ends + 1) / (n + v + 1))
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w) + 1, sum(c[x] > 0 for x in w) + 1, n)
        assert r["base_score"] == pytest.approx(base) and r["score"] < 0


def test_exchange_never_lowers_the_likelihood():
    rng = np.random.default_rng(0)
    groups = np.arange(40) % 4
    pairs = rng.poisson(5.0 * (groups[None, :] == (groups[:, None] + 1) % 4) + 0.05)

    def likelihood(label):
        g = np.eye(label.max() + 1)[label]
        j = g.T @ pairs @ g
        phi = lambda x: (x * np.log(np.maximum(x, 1e-300))).sum()
        return phi(j) - phi(j.sum(axis=0)) - phi(j.sum(axis=1))

    shuffled = rng.permutation(40)
    pairs = pairs[np.ix_(shuffled, shuffled)]
    assert likelihood(brown.exchange(pairs, 40, 4, 6)) >= likelihood(np.arange(40) % 4)


def test_gains_are_those_of_the_whole_likelihood():
    rng, k = np.random.default_rng(4), 4
    pairs = rng.poisson(0.6, (30, 30)).astype(float)
    label = np.concatenate([rng.integers(0, k, 27), [4, 5, 6]])

    def joint(lab):
        g = np.eye(7)[lab]
        return g.T @ pairs @ g

    g, own = np.eye(7)[label], np.diag(pairs)[:27].copy()
    out, into = (pairs @ g)[:27], (pairs.T @ g)[:27]
    for x in (out, into):
        x[np.arange(27), label[:27]] -= own
    gain = brown.gains(joint(label), k, label[:27], out, into, own)
    for w in range(27):
        for b in range(k):
            there = label.copy()
            there[w] = b
            assert gain[w, b] - gain[w, label[w]] == pytest.approx(brown.likelihood(joint(there)) - brown.likelihood(joint(label)), abs=1e-8)


def test_words_move_alike_however_their_rows_are_cut():
    """A word's evidence comes in several rows, which may lie in different batches."""
    rng, k, size = np.random.default_rng(5), 4, 7
    joint = rng.poisson(40, (size, size)).astype(float)
    rows = [(w, w % size, int(c), int(n)) for w in range(30) for c, n in zip(rng.integers(0, 2 * size + 1, 12), rng.integers(1, 9, 12), strict=True)]
    of = lambda part: brown.packed(*(np.array(x, np.int64) for x in zip(*part, strict=True)))
    got = []
    for step in (1, 5, 7, 12, len(rows)):
        parts = [of(rows[i : i + step]) for i in range(0, len(rows), step)]
        got.append([r for b in brown.move(joint, k)(iter(parts)) for r in zip(b["word"].to_pylist(), b["label"].to_pylist(), strict=True)])
    assert [w for w, _ in got[0]] == list(range(30)) and all(x == got[0] for x in got)
    whole = np.zeros((30, 2 * size + 1))
    for w, _, c, n in rows:
        whole[w, c] += n
    at = np.arange(30) % size
    gain = brown.gains(joint, k, at, whole[:, :size], whole[:, size:-1], whole[:, -1])
    for w, b in got[0]:
        assert b == at[w] or gain[w, b] == gain[w].max()


@pytest.mark.parametrize("known", [1 << 18, 60])
def test_all_frequent_words_are_clustered(spark, monkeypatch, known):
    """Words beyond the most frequent ones get their class from their neighbours, whether or not they travel; pairs are all counted."""
    monkeypatch.setattr(brown, "TOP", 40)
    monkeypatch.setattr(brown, "CLASSES", 8)
    monkeypatch.setattr(brown, "KNOWN", known)
    rng = random.Random(7)
    nouns, verbs = ([f"{c}{'x' * (i % 15)}{i}" for i in range(100)] for c in "nv")
    texts = [" ".join(rng.choice((nouns, verbs)[j % 2]) for j in range(60)) + f" once{i}" for i in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("held_out", brown.remainder(7) == 2)
    held = {r["doc_id"] for r in docs.where("held_out").collect()}
    model, rare = brown.fit(docs, brown.Scratch(spark, "test"))
    state = model.known
    of = dict(zip(state.word.tolist(), state.label.tolist(), strict=True)) | {r["word"]: r["label"] for r in rare.where("label is not null").collect()}
    classes = [{of[int(brown.tokens_of([w.encode()])[0][0])] for w in ws} for ws in (nouns, verbs)]
    assert not classes[0] & classes[1] and max(classes[0] | classes[1]) < state.k
    label = lambda w, i: of.get(int(w), -1) if of.get(int(w), -1) >= 0 else state.k + int(i)
    lp = {}
    n = Counter(w for i, t in enumerate(texts) if i not in held for w in brown.tokens_of([t.encode()])[0].tolist())
    inside = Counter()
    for w, c in n.items():
        if of.get(w, state.k) < state.k:
            inside[of[w]] += c
    for i, t in enumerate(texts):
        w, kind, _ = brown.tokens_of([t.encode()])
        path = [state.size - 1, *(label(x, y) for x, y in zip(w, kind, strict=True)), state.size - 1]
        lp[i] = sum(model.transition[a, b] for a, b in zip(path, path[1:], strict=False))
        lp[i] += sum(math.log10(n[x] / inside[c]) if c < state.k else math.log10(n[x] + 1) - model.rest[y] for x, y, c in zip(w.tolist(), kind, path[1:], strict=False))
    assert {r["doc_id"]: r["score"] for r in brown.score(docs.select("doc_id", "text")).collect()} == pytest.approx(lp)


def test_encoded_texts_and_their_class_bigrams(spark, monkeypatch):
    """The corpus is written once as codes; class bigrams count all words, also those that do not travel, of all training texts."""
    monkeypatch.setattr(brown, "TOP", 40)
    monkeypatch.setattr(brown, "CLASSES", 8)
    monkeypatch.setattr(brown, "KNOWN", 60)
    rng = random.Random(3)
    words = [f"w{'x' * (i % 15)}{i}" for i in range(150)]
    texts = [None, "", *(" ".join(w for _ in range(30) for w in [rng.choice(words)] * rng.choice((1, 1, 1, 2))) + f" once{i} once{i}" for i in range(150))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("held_out", brown.remainder(7) == 2)
    model, rare, whole, pairs = brown.fit_encoded(docs, brown.Scratch(spark, "test"))
    state = model.known
    assert state.some_rarer and len(state.word) <= 60 and pairs.count() > 0
    of = dict(zip(state.word.tolist(), state.label.tolist(), strict=True)) | {r["word"]: r["label"] for r in rare.where("label is not null").collect()}
    joint, seen = np.zeros((state.size, state.size)), 0
    for r in whole.collect():
        w, kind, _ = brown.tokens_of([(texts[r["doc_id"]] or "").encode()])
        code = np.frombuffer(r["low"], np.uint16) | np.frombuffer(r["high"], np.uint8).astype(np.int64) << 16
        others = iter(np.frombuffer(r["rare"], np.int64).tolist())
        assert code[0] == state.edge and [state.word[state.order[c]] if c < state.rest else next(others) for c in code[1:]] == w.tolist()
        assert list(others) == [] and [c - state.rest for c in code[1:] if c >= state.rest] == [k for c, k in zip(code[1:], kind, strict=True) if c >= state.rest]
        if not r["held_out"]:
            path = [state.size - 1, *(of.get(x, state.k + y) for x, y in zip(w.tolist(), kind.tolist(), strict=True)), state.size - 1]
            np.add.at(joint, (path[:-1], path[1:]), 1)
            seen += 1
    each = joint.sum(axis=0)
    prior = (each + 1) / (each.sum() + len(joint))
    # texts follow one another with a single edge between them
    assert seen == model.ends and model.transition == pytest.approx(np.log10((joint + brown.KAPPA * prior) / (joint.sum(axis=1, keepdims=True) + brown.KAPPA)))


def test_quality_figures_and_ratios(spark, small):
    rows = {r["doc_id"]: r for r in quality.query(spark, small).collect()}
    for r in table(spark, small).collect():
        w = [x.decode() for x in (r["text"] or "").encode().split()]
        tri = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {i + k for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in (r["text"] or "").split("\n") if x.encode().split()]
        got = rows[r["doc_id"]]
        assert (got["n_words"], got["word_chars"], got["n_dup_lines"], got["n_repeat_words"]) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(covered))
    labels = {r["doc_id"]: r["quality"] for r in table(spark, small, "labels").collect()}
    good = [rows[d]["kept"] for d, q in labels.items() if q == 1 and not rows[d]["base_failed"]]
    assert sum(good) >= 0.95 * len(good)


def test_pieces_against_enumeration():
    v = pieces.vocabulary("piece_bpe_32k.model")
    rng = random.Random(3)
    for _ in range(60):
        text = "".join(rng.choice("thein éo ☃²") for _ in range(rng.randint(1, 7)))
        word, found = "▁" + text.replace(" ", "▁"), []

        def go(at, score, ids):
            if at == len(word):
                found.append((score, ids))
            for end in range(at + 1, min(len(word), at + 16) + 1):
                if piece := v.of.get(word[at:end]):
                    go(end, score + piece[1], (*ids, piece[0]))
                elif end == at + 1:
                    raw = word[at].replace("▁", " ").encode()
                    go(end, score + len(raw) * v.byte_score, ids + tuple(v.byte[b] for b in raw))

        go(0, 0.0, ())
        scores, ids, spelt = v.segment(text)
        assert [round(x, 6) for x in scores] == [round(x[0], 6) for x in sorted(found, key=lambda x: -x[0])[:3]]
        assert spelt.decode() == text and all(v.decode(np.frombuffer(i, "<i4")) == text for i in ids)


@pytest.mark.parametrize("letters", ["thein", "=-", "é中文字", "01 ", "☃a"])
def test_long_words_are_segmented_whole(letters):
    """A 1000-character word against the uncut lattice: the N best of every place, kept from front to end."""
    v, rng = pieces.vocabulary("piece_bpe_32k.model"), random.Random(9)
    text = "".join(rng.choice(letters) for _ in range(1000)) if letters != "01 " else " " * 300 + "01" * 350
    word = "▁" + text.replace(" ", "▁")
    best, widest = [[(0.0, None)]] + [[] for _ in word], max(map(len, v.of))
    for end in range(1, len(word) + 1):
        for start in range(max(0, end - widest), end):
            piece = v.of.get(word[start:end])
            score = piece[1] if piece else len(word[start].replace("▁", " ").encode()) * v.byte_score if start == end - 1 else None
            if score is not None:
                best[end] += [(x + score, start) for x, _ in best[start]]
        best[end] = sorted(best[end], key=lambda x: -x[0])[:3]
    scores, ids, spelt = v.segment(text)
    assert scores == pytest.approx([x for x, _ in best[-1]], abs=1e-6)
    assert len(set(ids)) == len(best[-1]) and spelt.decode() == text
    for x, score in zip(ids, scores, strict=True):
        own = np.frombuffer(x, "<i4").tolist()
        assert v.decode(own) == text and sum(v.score.get(i, v.byte_score) for i in own) == pytest.approx(score)
    short = word[:150]
    assert [x for x, _ in v.best_of_long_word(short)] == pytest.approx([x for x, _ in v.best_of_word(short)])


def test_personal_data_hard_cases(spark):
    texts = {1: "a@b.com@d.org x.y@z..co a@b.c_d@e.fg", 2: "1.2.3.4.5.6.7.8 300.1.1.1 001.002.003.255", 3: "4111 1111 1111 1111, 4111-1111--1111-1111", 4: "+1 (555) 123-4567. +49..123", 5: "𝒳 DE89 3704 0044 0532 0130 00 bank", 6: "1 2 " * 20000, 7: "a" * 100000 + "@", 8: "x@" + "a." * 20000}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: [(x["kind"], x["start"], x["stop"]) for x in r["pii"]] for r in pii.find(df).collect()}
    assert got[1] == [("email", 0, 7), ("email", 24, 29), ("email", 29, 36)]
    assert got[2] == [("ip", 0, 7), ("ip", 8, 15), ("ip", 26, 41)]
    assert got[3] == [("card", 0, 19)] and got[4] == [("phone", 0, 17)] and got[5] == [("iban", 2, 29)]
    assert got[6] == [] and got[7] == [] and got[8][0][1:] == (0, 40001)
    red = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert red[5] == "𝒳 [IBAN] bank" and red[3].startswith("[CARD], 4111")


def test_chats_read_back(spark):
    rng = random.Random(9)
    bits = ["</s>", "[INST]", "[/INST]", "<s>", "<<SYS>>", "<</SYS>>", "<|turn|>", "\\", "<", "a", " ", "<|role|>", "\\\\<s>", "[", ""]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", "<s>"]), "".join(rng.choice(bits) for _ in range(rng.randint(0, 6)))) for c in range(40) for t in range(rng.randint(1, 7))]
    out = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    for r in out.select("conv_id", chat.read_turns(F.col("formatted")).alias("t"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect():
        own = [x for x in rows if x[0] == r["conv_id"]]
        assert [(t["role"], t["text"]) for t in r["t"]] == [(x[2], x[3]) for x in own]
        assert r["loss"] == "".join(x[3] for x in own if x[2] == "assistant")
