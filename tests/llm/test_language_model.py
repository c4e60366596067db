import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from barloom.llm import language_model
from barloom.llm.queries import op10_lm_scoring
from tests.llm.brute import words

SCHEMA = "report_id bigint, report string, learn boolean"


def brute(rows, prior=language_model.PRIOR):
    """(n_tokens, n_known, train_tokens, base, score) by plain dictionaries."""
    uni, pairs, state = Counter(), Counter(), Counter()
    for _, t, learn in rows:
        if learn:
            tokens = [*words(t), 0]
            uni.update(tokens)
            pairs.update(zip([1, *tokens], tokens))
            state.update([1, *tokens[:-1]])
    n, v = sum(uni.values()), len(uni)

    def root(w):
        return (uni[w] + 0.5) / (n + 0.5 * (v + 1))

    out = []
    for i, t, _ in rows:
        tokens = [*words(t), 0]
        base = sum(math.log10(root(w)) for w in tokens)
        score = sum(
            math.log10((pairs[h, w] + prior * root(w)) / (state[h] + prior)) for h, w in zip([1, *tokens], tokens)
        )
        out.append((i, len(tokens), sum(uni[w] > 0 for w in tokens), n, base, score))
    return sorted(out)


def close(got, want):
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:4] == w[:4] and np.allclose(g[4:], w[4:], rtol=1e-9)


def run(spark, rows, schema=SCHEMA):
    return sorted(tuple(r) for r in language_model.score_reports(spark.createDataFrame(rows, schema)).collect())


def test_whole_table_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    rows = [(r.doc_id, r.text, zlib.crc32(str(r.doc_id).encode()) % 5 != 1) for r in docs]
    got = op10_lm_scoring(spark, sf)
    cells = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    close(sorted(tuple(r) for r in got.select(cells).collect()), brute(rows))
    assert {r.doc_id: not r.held_out for r in got.collect()} == {i: learn for i, _, learn in rows}


def test_edges(spark):
    rows = [(1, None, True), (2, "", False), (3, "The the THE end", True), (4, "new words", None), (5, "the " * 20000, True),
            (6, "the end", True), (6, "the end", True)]
    close(run(spark, rows), brute(rows))
    nothing = [(i, t, False) for i, t, _ in rows]
    close(run(spark, nothing), brute(nothing))
    close(run(spark, [(*r, 1) for r in rows], SCHEMA + ", block int"), brute(rows))
    assert run(spark, []) == []


def test_a_state_sums_to_one():
    """Over the learnt words and one unknown word, the arcs of a state share out probability one."""
    uni = {"a": 5, "b": 3, "end": 2}
    n, v, prior = 10, 3, language_model.PRIOR
    root = {w: (c + 0.5) / (n + 0.5 * (v + 1)) for w, c in [*uni.items(), ("?", 0)]}
    assert math.isclose(sum(root.values()), 1)
    pairs = {"a": 2, "b": 3}
    assert math.isclose(sum((pairs.get(w, 0) + prior * r) / (5 + prior) for w, r in root.items()), 1)
    table = pa.table({"report_id": [1], "report": ["a b"], "learn": [True]})
    assert language_model.Block(table).n.tolist() == [3]
