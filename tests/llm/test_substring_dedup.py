import hashlib
import random

import numpy as np
import pytest

from barloom.llm import substring_dedup
from barloom.llm.fm_index import PassageIndex
from barloom.llm.queries import op6_substring_dedup
from tests.llm.brute import words

SCHEMA = "report_id bigint, report string"


def brute(rows, width=50):
    first: dict = {}
    split = {i: words(t, fold=False) for i, t in rows}
    for i, w in split.items():
        for s in range(len(w) - width + 1):
            key = tuple(w[s : s + width])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, w in split.items():
        gone = set()
        for s in range(len(w) - width + 1):
            if first[tuple(w[s : s + width])] < i:
                gone.update(range(s, s + width))
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def run(spark, rows, schema=SCHEMA):
    out = substring_dedup.remove_repeats(spark.createDataFrame(rows, schema)).collect()
    return {r.report_id: (r.n_words, r.n_removed, r.kept) for r in out}


def corpus(rng):
    vocabulary = [f"W{i}é" for i in range(300)]
    passages = [rng.choices(vocabulary, k=k) for k in (50, 51, 64, 130, 400)]
    rows = []
    for i in range(150):
        w = []
        for _ in range(rng.randrange(4)):
            w += rng.choices(vocabulary, k=rng.randrange(60))
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            w += rng.choice([p, p[a:], p[:a], p[a:] + p[:a]])
        if rng.random() < 0.3 and rows:
            w = rows[rng.randrange(len(rows))][1].split()
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w)) if w else 0 :][:1] = ["new"]
        rows.append((i * 3 % 150 if i % 50 else i * 3 % 150 + 1000 + i, rng.choice([" ", "\n", " \t "]).join(w)))
    return list(dict(rows).items())


def test_whole_table_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = {i: (n, g, hashlib.sha256(k.encode()).hexdigest()) for i, (n, g, k) in brute(rows).items()}
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in op6_substring_dedup(spark, sf).collect()}
    assert got == want
    assert sum(g for _, g, _ in want.values())


@pytest.mark.parametrize("hot", [8192, 3])
def test_corpus_equals_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    rows = corpus(random.Random(7))
    assert run(spark, rows) == brute(rows)


def test_edges(spark):
    rows = [
        (1, None), (2, ""), (3, " \n"), (4, "a " * 49), (5, "a " * 50), (6, "a " * 51), (7, "a " * 20000), (8, "A " * 50),
        (9, "b " + "a " * 50 + "c"),
    ]
    assert run(spark, rows) == brute(rows)
    assert run(spark, [(*r, 2, "x") for r in rows], SCHEMA + ", n_words int, kept string") == brute(rows)
    assert run(spark, []) == {}
    text = " ".join(f"w{i}" for i in range(60))
    twice = substring_dedup.remove_repeats(spark.createDataFrame([(4, text), (4, text), (5, text)], SCHEMA))
    assert sorted((r.report_id, r.n_removed) for r in twice.collect()) == [(4, 0), (4, 0), (5, 60)]


def test_index_finds_the_first_window():
    rng = np.random.default_rng(1)
    passages = [rng.integers(0, 4, rng.integers(1, 40)).astype(np.uint64) for _ in range(60)]
    owners = rng.permutation(60)
    got = PassageIndex(passages, owners).first_repeat(passages, owners, 5)
    for k, p in enumerate(passages):
        want = -1
        for s in range(len(p) - 4):
            window = p[s : s + 5].tolist()
            if any(
                owners[j] < owners[k] and any(q[t : t + 5].tolist() == window for t in range(len(q) - 4))
                for j, q in enumerate(passages)
            ):
                want = s
                break
        assert got[k] == want
