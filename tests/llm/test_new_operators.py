"""Line dedup, Merkle manifest and fill-in-the-middle against plain Python, on hard small tables."""

import hashlib
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lapsewise.llm import fim, line_dedup, merkle
from lapsewise.llm.shared import Scratch

LONG = "x" * 1_000_000
#: nulls, empty and very long texts, ties, repeated rows, a row without doc_id, extra columns with inner names
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, id string, key string, place long, g string, i long, n long, h string, path string, kept string, form string, output string"
EXTRA = ("x", "x", "x", 1, "x", 1, 1, "x", "x", "x", "x", "x")


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA)


HARD = [
    (1, "a\nb\n\nA \n b", "en", "s", 3), (2, None, None, None, None), (3, "", "en", "s", 0), (4, LONG + "\nb\n" + LONG, "en", "s", 1), (5, "\n" * 2000 + "b", "en", "t", 1),
    (6, "tail\n", "de", "s", 1), (6, "tail\n", "de", "s", 1), (None, "é ☃\nb\r\n\tB", None, None, 1), (None, "é ☃\nb\r\n\tB", None, None, 1), (7, "<P>no\nb", "en", "é", 1), (8, "one line", "en", "s", 1),
]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- lines --------------------------------------------------------------------------------------------------------


def lines_by_hand(texts, least):
    keys = lambda t: [x.strip(" \t\n\x0b\x0c\r").translate({i: i + 32 for i in range(65, 91)}) for x in (t or "").split("\n")]
    docs = Counter(k for t in texts for k in set(keys(t)) if k)
    gone = {k for k, n in docs.items() if n >= least}
    return [((t or "").count("\n") + 1, sum(k in gone for k in keys(t)), "\n".join(x for x, k in zip((t or "").split("\n"), keys(t), strict=True) if k not in gone)) for t in texts]


def test_lines_of_hard_rows(spark):
    df = docs_of(spark, HARD)
    got = Counter((r["row"]["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in line_dedup.dedup_lines(df, least_docs=3).collect())
    assert got == Counter((h[0], *x) for h, x in zip(HARD, lines_by_hand([h[1] for h in HARD], 3), strict=True))
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0
    assert line_dedup.dedup_lines(df).first()["row"]["key"] == "x"


def test_runs_in_any_number_of_batches(spark):
    rng = random.Random(5)
    texts = ["\n".join(f" Line {int(rng.paretovariate(0.6)) % 400} " for _ in range(rng.randint(0, 12))) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").cache()
    want = {i: x for i, x in enumerate(lines_by_hand(texts, 4))}
    for n in (1, 3, 6):
        out = line_dedup.dedup_lines(df, [df.where(F.col("doc_id") % n == k) for k in range(n)], least_docs=4)
        assert {r["row"]["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept"]) for r in out.collect()} == want


def test_levels_compact_and_settle(spark):
    runs = line_dedup.LineRuns(Scratch(spark, "levels"), least_docs=3)
    batch = lambda k: spark.createDataFrame([(k, f"always\nown {k}\nfirst {k < 2}")], "doc_id long, text string")
    for k in range(5):
        runs.add(batch(k))
    assert [bool(x) for x in runs.counts.levels] == [True, False, True]
    always = hashlib.sha256(b"always").digest()[:16]
    assert any(bytes(r["key"]) == always for run in runs.settled.runs() for r in run.collect())
    # the fifth batch left out what was settled by then, and a merge of runs shuffles nothing
    assert runs.counts.runs()[0].count() == 2  # its own line, and the one that two others have so far
    a, b = spark.table(runs.counts.levels[0]), spark.table(runs.counts.levels[2])
    assert "Exchange" not in a.hint("merge").join(b, "key", "full")._jdf.queryExecution().executedPlan().toString()
    assert {bytes(r["key"]) for r in runs.frequent().collect()} == {hashlib.sha256(k).digest()[:16] for k in (b"always", b"first false")}
    runs.clear()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("lapsewise_") and runs.scratch.base in str(t)]


def test_lines_are_summed_before_they_are_shuffled(spark):
    runs = line_dedup.LineRuns(Scratch(spark, "plan"), least_docs=1)
    df = spark.createDataFrame([(1, "a\nb")], "doc_id long, text string")
    runs.add(df)
    runs.add(df)
    plan = runs.unsettled(line_dedup.counted(df))._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Exchange") :]
    assert "partial_count" in below and plan.index("SortMergeJoin") < plan.index("Exchange")
    runs.clear()


def test_keys_have_a_least_length(spark):
    df = spark.createDataFrame([(i, f"é\nlong line\n{i}") for i in range(4)], "doc_id long, text string")
    runs = line_dedup.LineRuns(Scratch(spark, "least"), least_docs=2, least_chars=2)
    runs.add(df)
    assert runs.frequent().count() == 1
    runs.clear()


# ---- manifest -----------------------------------------------------------------------------------------------------


def manifest_by_hand(rows, fanout):
    """Counter of (doc_id, leaf, subroot, root, proof digest, folded root after tampering)."""
    def h(*parts):
        return sha("".join(parts))

    def leaf(r, text):
        return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], text)])

    def tree(nodes):
        """Root and, for each node, its steps (left, right)."""
        steps, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
        while len(level) > 1:
            for k, i in enumerate(at):
                run = level[i // fanout * fanout :][:fanout]
                steps[k].append(("".join(run[: i % fanout]), "".join(run[i % fanout + 1 :])))
            level = [h(*level[j : j + fanout]) for j in range(0, len(level), fanout)]
            at = [i // fanout for i in at]
        return level[0], steps

    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        trees[s] = tree([leaf(r, r[1]) for r in by[s]])
    root, above = tree([trees[s][0] for s in sources])
    out = Counter()
    for s, up in zip(sources, above, strict=True):
        for r, own in zip(by[s], trees[s][1], strict=True):
            steps = own + up
            node = leaf(r, r[1])
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None:
                node = leaf(r, r[1].translate({i: i + 32 for i in range(65, 91)}))
            for a, b in steps:
                node = h(a, node, b)
            out[r[0], leaf(r, r[1]), trees[s][0], root, h(*[a + b for a, b in steps]), node] += 1
    return out


@pytest.mark.parametrize("fanout", [2, 3, 16])
def test_manifest_by_hand(spark, fanout):
    rng = random.Random(fanout)
    rows = HARD + [(rng.randint(-5, 90), rng.choice(["Text", "text", None, f"T{k}"]), "en", rng.choice(["s", "s", "s", "t", None, "z\U0001f600", "zé"]), k) for k in range(120)]
    df = docs_of(spark, rows)
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(hit, merkle.leaf(*[lowered if c == "text" else F.col(c) for c in merkle.COLUMNS]))
    out = merkle.manifest(df, fanout=fanout, also={"tampered": tampered})
    out = out.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")), merkle.fold(F.coalesce("tampered", "leaf"), F.col("path")))
    assert Counter(tuple(r) for r in out.collect()) == manifest_by_hand(rows, fanout)


def test_manifest_of_few_rows(spark):
    df = docs_of(spark, HARD)
    assert merkle.manifest(df.limit(0)).count() == 0
    one = merkle.manifest(df.where("doc_id = 8")).first()
    assert one["leaf"] == one["subroot"] == one["root"] and one["path"] == []


def test_manifest_shows_what_was_changed(spark, small):
    rows = merkle.query(spark, small).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    lowered = lambda t: t.translate({i: i + 32 for i in range(65, 91)})
    assert len({r["root"] for r in rows}) == 1 and len(rows) == len(texts)
    for r in rows:
        t = texts[r["doc_id"]]
        assert r["verified"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 != 0 or t is None or lowered(t) == t)


# ---- fill in the middle -------------------------------------------------------------------------------------------


@pytest.mark.parametrize("chunk", [1, 7, 65_536])
def test_fill_in_middle_by_hand(spark, chunk):
    rng = random.Random(chunk)
    rows = (HARD if chunk > 7 else [h for h in HARD if h[0] != 4]) + [(1000 + k, "".join(rng.choice("ab \n☃") for _ in range(rng.randint(0, 60))), "en", "s", 1) for k in range(80)]
    df = docs_of(spark, rows).repartition(3)
    want = Counter()
    for doc, text, *_ in rows:
        text = text or ""
        lines = [x for x in text.split("\n")]
        units = [x + "\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] else [])
        n = len(units)
        hs = [int(sha(f"7:{'' if doc is None else doc}")[8 * i : 8 * i + 8], 16) for i in range(4)]
        a, b = sorted((hs[0] % (n + 1), hs[1] % (n + 1)))
        p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
        if not text or any(x in text for x in ("<P>", "<S>", "<M>")):
            want[doc, n, "plain", None, None, text, sha(text), sha(text)] += 1
        else:
            form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if hs[3] % 100 < 50 else ("psm", f"<P>{p}<S>{s}<M>{m}")
            want[doc, n, form, len(p), len(m), out, sha(out), sha(text)] += 1
            assert fim.restore(out, form) == text
    assert Counter(tuple(r) for r in fim.fill_in_middle(df, chunk=chunk).collect()) == want


def test_fill_in_middle_without_rows_or_at_no_rate(spark):
    df = docs_of(spark, HARD)
    assert fim.fill_in_middle(df.limit(0)).count() == 0
    assert {r["form"] for r in fim.fill_in_middle(df, rate=0).collect()} == {"plain"}
