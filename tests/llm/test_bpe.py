import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from barloom.llm import bpe
from barloom.llm.queries import word_vocabulary

SCHEMA = "report_id bigint, report string"
POOL = "aAbBß éÉΣσς'stdreve0123٣½!?…<|>endoftextstar   \x00\x1c\x85\n\t́é中文字🙂👍ﬁİıǅ"


@pytest.fixture(scope="module")
def vocabulary():
    return word_vocabulary()


def run(spark, rows, vocabulary, schema=SCHEMA):
    encoded = bpe.encode_reports(spark.createDataFrame(rows, schema), vocabulary)
    out = bpe.decode_tokens(encoded, vocabulary).collect()
    once = bpe.round_trip(spark.createDataFrame(rows, schema), vocabulary).collect()
    assert sorted(map(tuple, once)) == sorted(map(tuple, out))
    return [(r.report_id, np.frombuffer(r.token_ids, "<u4").tolist(), r.decoded) for r in out]


def want(rows, vocabulary):
    t = Tokenizer.from_str(vocabulary)
    out = []
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        out.append((i, ids, t.decode(ids, skip_special_tokens=False)))
    return out


def test_equals_the_library(spark, vocabulary):
    rng = random.Random(2)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    rows = [tuple(r) for r in docs]
    rows += [(1000 + i, "".join(rng.choices(POOL, k=rng.randrange(60)))) for i in range(1500)]
    rows += [
        (1, None), (2, ""), (3, " \n"), (4, "<|endoftext|>abc<|startoftext|>X<|ENDOFTEXT|>"), (5, "a" * 5000),
        (6, "it's I'LL we've 'd''s"), (7, "ab" * 3000), (7, "ab" * 3000),
    ]
    assert sorted(run(spark, rows, vocabulary)) == sorted(want(rows, vocabulary))


def test_empty_and_extra_columns(spark, vocabulary):
    assert run(spark, [], vocabulary) == []
    got = run(spark, [(1, "Hi there", 3, "x")], vocabulary, SCHEMA + ", token_ids int, decoded string")
    assert got == want([(1, "Hi there")], vocabulary)
    odd = spark.createDataFrame([(1, bytearray(np.array([320, 99999, 320], "<u4").tobytes())), (2, None)],
                                "report_id bigint, token_ids binary")
    texts = {r.report_id: r.decoded for r in bpe.decode_tokens(odd, vocabulary).collect()}
    assert len(texts[1].split()) == 2 and texts[2] == ""


def test_check_of_pairs_decides_like_merging(vocabulary):
    v = bpe.Vocabulary(vocabulary)
    rng = np.random.default_rng(0)
    inner = [i for t, i in v.id_of.items() if not t.endswith(v.suffix)]
    a, b = rng.choice(inner, 20000), rng.choice(list(v.id_of.values()), 20000)
    got = v.compatible(a, b)
    for x, y, g in zip(a.tolist(), b.tolist(), got.tolist()):
        assert (v.exact(v.symbols(v.token_of[x]) + v.symbols(v.token_of[y])) == [x, y]) == g or (
            not v.token_of[y]
        )
    assert 0 < got.sum() < len(got)


def test_memory_of_a_task_follows_its_size(vocabulary):
    """Many new pieces in one batch: they are taken in steps that fit the memory."""
    v = bpe.Vocabulary(vocabulary)
    texts = [" ".join(f"w{i * 100 + j}" for j in range(100)) for i in range(400)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(400)), pa.array(texts)], ["report_id", "report"])
    encoder = bpe.Encoder(v, memory=2000)
    ids = [i for part in bpe._encoded(batch, encoder) for i in part.column("token_ids").to_pylist()]
    assert max(len(m) for m in (encoder.pieces, encoder.pieces.old)) <= 2 * 2000
    assert max(len(m) for m in (encoder.words, encoder.words.old)) <= 4 * 2000
    t = Tokenizer.from_str(vocabulary)
    assert [np.frombuffer(x, "<u4").tolist() for x in ids[::40]] == [t.encode(x, add_special_tokens=False).ids for x in texts[::40]]
