"""Operator 13 against plain comparison of every word with the one a period further on."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from statforge.llm.periodic_runs import Text, find_runs, op13_periodic_runs, periodic_runs, planted

from .cases import EDGE_TEXTS, SCHEMA, edge_documents

SF = "/root/testdata/sf0.001"


def plain_runs(words, shortest=24, periods=3):
    out, n = [], len(words)
    for q in range(1, n // periods + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            part = words[i : j + q]
            if len(part) >= max(shortest, periods * q) and not any(part[d:] == part[:-d] for d in range(1, q)):
                out.append((i, len(part), q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_collapse(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_runs_of_random_strings():
    r = random.Random(1)
    for _ in range(3000):
        k, n = r.choice([1, 2, 2, 3, 4]), r.randint(0, 30)
        s = [r.randrange(k) for _ in range(n)]
        if r.random() < 0.3 and n > 4:
            a = r.randrange(n)
            p = r.randint(1, max(1, (n - a) // 2))
            s = [s[i] if i < a else s[a + (i - a) % p] for i in range(n)]
        assert [tuple(x) for x in periodic_runs(np.array(s, np.int64)).tolist()] == plain_runs(s, 0, 2), s


def test_blocks_are_longest_earlier_factors():
    r = random.Random(2)
    for _ in range(300):
        s = "".join(r.choice("ab") for _ in range(r.randint(1, 40)))
        at, want = 0, []
        while at < len(s):
            want.append(at)
            at += max([1, *[n for n in range(1, len(s) - at + 1) if s.find(s[at : at + n]) < at]])
        assert Text(np.array([ord(c) for c in s])).blocks().tolist() == [*want, len(s)]


@pytest.mark.parametrize("kind", ["one word", "fibonacci", "tiled"])
def test_long_strings(kind):
    n = 20_000
    if kind == "one word":
        assert periodic_runs(np.zeros(n, np.int64)).tolist() == [[0, n, 1]]
    elif kind == "tiled":
        s = np.tile(np.arange(500), 40)
        assert periodic_runs(s).tolist() == [[0, n, 500]]
    else:
        a, b = "a", "ab"
        while len(b) < 2000:
            a, b = b, b + a
        s = [ord(c) for c in b[:2000]]
        assert [tuple(x) for x in periodic_runs(np.array(s)).tolist()] == plain_runs(s, 0, 2)


def repeated_texts(seed, n):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        vocabulary = [f"w{i}" for i in range(r.choice([2, 5, 400]))]
        words = []
        while len(words) < r.randint(0, 200):
            part = [r.choice(vocabulary) for _ in range(r.randint(1, 20))]
            words += (part * r.randint(1, 6))[: r.randint(1, 120)]
        out.append("".join(w + r.choice([" ", "\n", "  ", "\t"]) for w in words))
    return out


def test_documents_against_plain_runs(spark):
    texts = [*EDGE_TEXTS, *repeated_texts(3, 300), "a b c " * 9, "a " * 24, "a " * 23, "a b " * 400_000]
    got = {r.doc_id: r for r in find_runs(edge_documents(spark, texts)).collect()}
    for i, text in enumerate(texts[:-1]):
        words = words_of(text)
        runs = plain_runs(words)
        assert [(r.start, r.length, r.period) for r in got[i].runs] == runs, text
        assert got[i].collapsed == plain_collapse(words, runs)
    last = got[len(texts) - 1]
    assert [tuple(r) for r in last.runs] == [(0, 800_000, 2)] and last.collapsed == "a b"


def test_query(spark):
    rows = {r.doc_id: r for r in op13_periodic_runs(spark, SF).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert set(rows) == set(texts)
    found = 0
    for i, text in texts.items():
        words, h = words_of(text), zlib.crc32(str(i).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        runs, r = plain_runs(words), rows[i]
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *(best or (None, None, None)))
        assert r.exponent_milli == (1000 * best[1] // best[2] if best else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(plain_collapse(words, runs).encode()).hexdigest()
        found += len(runs)
    assert found > 5


def test_edges(spark):
    assert find_runs(spark.createDataFrame([], SCHEMA)).count() == 0
    docs = spark.createDataFrame([(None, "a " * 30, 1), (1, None, 2), (1, None, 2)], "doc_id long, text string, runs long")
    got = sorted((str(r.doc_id), len(r.runs), r.collapsed) for r in find_runs(docs).collect())
    assert got == [("1", 0, ""), ("1", 0, ""), ("None", 1, "a")]
    assert planted(docs).count() == 3
