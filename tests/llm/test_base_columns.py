"""The contract's base columns of whole queries, recomputed with plain Python over every document of a small table."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from lapsewise.llm import brown, pii, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts(spark, small):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}


def test_quality_base_columns(spark, small, texts):
    got = {r["doc_id"]: r for r in quality.query(spark, small).collect()}
    assert set(got) == set(texts)
    for doc, t in texts.items():
        words = WORD.findall(t)
        windows = list(zip(words, words[1:], words[2:], strict=False))
        times = Counter(windows)
        repeated = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            dup += bool(WORD.search(line)) and line in seen
            seen.add(line)
        r = got[doc]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(words), sum(map(len, words)), sum(c in "[#*$%&|<>]" and c not in "[]" for c in t), dup, len(repeated)), doc
        failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
        assert r["base_failed"] == failed and not (failed and r["kept"])


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(t):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append((m.start(), 0, "email", m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        digits = re.sub(r"[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 10 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, "phone", m.end()))
    return sorted(out)


def test_personal_data_base_columns(spark, small, texts):
    got = {r["doc_id"]: r for r in pii.query(spark, small).collect()}
    assert set(got) == set(texts)
    found = Counter()
    for doc, t in texts.items():
        spans = base_spans(t)
        kinds = Counter(s[2] for s in spans)
        found += kinds
        joined = ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans)
        r = got[doc]
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == tuple(kinds[k] for k in ("email", "ip", "card", "phone")), doc
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest(), doc
        assert set(filter(None, joined.split(","))) <= set(r["spans"].split(","))
    assert all(found[k] for k in ("email", "ip", "card", "phone"))


def test_scoring_base_columns(spark, small, texts):
    got = {r["doc_id"]: r for r in brown.query(spark, small).collect()}
    assert set(got) == set(texts)
    lower = {i: i + 32 for i in range(65, 91)}
    tokens = {doc: [*WORD.findall(t.translate(lower)), None] for doc, t in texts.items()}
    held = {doc: zlib.crc32(str(doc).encode()) % 7 == 2 for doc in texts}
    counts = Counter(x for doc, ts in tokens.items() if not held[doc] for x in ts)
    n, v = sum(counts.values()), len(counts)
    for doc, ts in tokens.items():
        r = got[doc]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[doc], len(ts), sum(counts[x] > 0 for x in ts), n), doc
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in ts), rel=1e-9), doc
        assert r["score"] < 0
