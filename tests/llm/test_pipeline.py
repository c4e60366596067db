import re

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from barloom.llm import jaccard_join
from barloom.llm.common import BATCH
from barloom.llm.queries import word_vocabulary
from tests.llm.brute import components
from tests.llm.test_decontaminate import brute as leaks

SF = "/root/testdata/sf0.001"


def test_stages_equal_brute_force(spark):
    columns = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    leak = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    more = [(9001, None, "en", "s", None), (9002, "", None, "s", 0), (9003, "12 34", "en", None, 5),
            (9004, "Before this. " + leak + " and after it", "en", "s", 1), (9004, "Before this. " + leak + " and after it", "en", "s", 1)]
    docs = docs.unionByName(spark.createDataFrame(more, columns))
    at = [(r.doc_id, r.text) for r in docs.collect()]
    stages = dict(corpus_pipeline.STAGES)

    kept = stages["language_id"](spark, docs, SF)
    assert kept.columns == docs.columns
    after = {r.doc_id: r.text for r in kept.collect()}
    assert set(after) == {i for i, t in at if t and any(map(str.isalpha, t))}

    kept = stages["exact_dedup"](spark, kept, SF)
    groups = {}
    for i, t in after.items():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t), []).append((-len(t), i))
    after = {min(g)[1]: after[min(g)[1]] for g in groups.values()}
    assert {r.doc_id for r in kept.collect()} == set(after)

    kept = stages["jaccard_join"](spark, kept, SF)
    after = {i: after[i] for i, (_, root) in components(list(after.items())).items() if i == root}
    assert {r.doc_id for r in kept.collect()} == set(after)

    kept = stages["decontamination"](spark, kept, SF)
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    after = {i: t for i, t in after.items() if i not in {d for d, *_ in leaks(list(after.items()), items)}}
    assert {r.doc_id for r in kept.collect()} == set(after) and 9004 not in after

    t = Tokenizer.from_str(word_vocabulary())
    out = {r.doc_id: np.frombuffer(r.token_ids, "<u4").tolist() for r in stages["bpe"](spark, kept, SF).collect()}
    assert out == {i: t.encode(x, add_special_tokens=False).ids for i, x in after.items()}


def test_run_and_empty_table(spark, tmp_path):
    out = corpus_pipeline.run(spark, SF)
    assert 0 < out.count() < 200 and "token_ids" in out.columns
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    docs = empty
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_least_score_follows_the_number_of_languages(spark, monkeypatch):
    language_id = corpus_pipeline.language_id
    docs = spark.createDataFrame([(i, "text", "a") for i in range(4)], "doc_id bigint, text string, lang string")
    # mean probabilities of the four texts
    for languages, scores, kept in (
        (1, (1.0, 1.0, 1.0, 1.0), {0, 1, 2, 3}), (2, (0.5, 0.55, 0.65, 1.0), {2, 3}), (4, (0.25, 0.29, 0.3, 0.9), {2, 3}),
        (40, (0.025, 0.028, 0.04, 0.2), {2, 3}),
    ):
        network = language_id.Network.fresh([f"l{k:02}" for k in range(languages)])
        found = spark.createDataFrame(list(zip(range(4), ["l00"] * 4, scores)), "text_id bigint, lang string, score double")
        monkeypatch.setattr(language_id, "train", lambda texts: network)
        monkeypatch.setattr(language_id, "identify", lambda texts, net: found)
        assert {r.doc_id for r in corpus_pipeline.identify_language(spark, docs, SF).collect()} == kept


def test_rows_go_by_row(spark):
    """Repeated rows, ids shared by different texts, and null ids, by row counts."""
    columns = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    stages = dict(corpus_pipeline.STAGES)
    leak = spark.read.parquet(f"{SF}/benchmark.parquet").first().text

    def left(name, rows):
        frame = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], columns).repartition(3)
        out = stages[name](spark, frame, SF)
        assert out.columns == frame.columns
        return sorted(((r.doc_id, r.text) for r in out.collect()), key=str)

    a, b = "the first clean text of this table here", "quite another one that nobody else has written"
    near = " ".join(f"w{i}" for i in range(60))
    assert left("language_id", [(1, a), (1, "12 34"), (None, b), (None, "56"), (None, None)]) == [(1, a), (None, b)]
    assert left("exact_dedup", [(1, a), (1, a), (2, b), (2, a), (None, b), (None, b), (None, leak)]) == [
        (1, a), (2, b), (None, leak)]
    assert left("jaccard_join", [(3, near), (3, near), (1, near + " x"), (3, a), (None, near), (None, b)]) == [
        (1, near + " x"), (3, a), (None, b)]
    leaking = f"Before this. {leak} and after it"
    assert left("decontamination", [(1, a), (1, leaking), (None, b), (None, leaking), (2, a), (2, a)]) == [
        (1, a), (2, a), (2, a), (None, b)]
    assert len(stages["bpe"](spark, spark.createDataFrame([(1, a), (1, b), (None, a)], "doc_id bigint, text string"), SF).collect()) == 3


def test_python_steps_end_within_a_stage_and_get_small_batches(spark, monkeypatch):
    """Workers and heap live on from stage to stage, so no stage leaves its Python steps to a later write."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, seen = spark.conf.get(name, None), []
    for module, step in ((corpus_pipeline.language_id, "identify"), (corpus_pipeline.exact_dedup, "exact_duplicates"),
                         (corpus_pipeline.bpe, "round_trip")):
        def noted(*args, real=getattr(module, step), **options):
            seen.append(spark.conf.get(name, None))
            return real(*args, **options)

        monkeypatch.setattr(module, step, noted)
    docs = spark.createDataFrame([(1, "some text", "en"), (2, "other text", "en")], "doc_id bigint, text string, lang string")
    for stage in ("language_id", "exact_dedup", "bpe"):
        out = dict(corpus_pipeline.STAGES)[stage](spark, docs, SF)
        assert "InArrow" not in out._jdf.queryExecution().toString() and out.count() == 2
        assert spark.conf.get(name, None) == before
    assert seen == [str(BATCH)] * 3


def test_near_copies_of_other_lengths_are_not_asked(spark, monkeypatch):
    """Documents that share a passage but never a length that can link are searched by themselves, once."""
    monkeypatch.setattr(jaccard_join, "GROUP", 4)
    monkeypatch.setattr(jaccard_join, "SHARED", 1)
    monkeypatch.setattr(jaccard_join, "OFTEN", 1000)
    searched, plain = [], jaccard_join.links
    monkeypatch.setattr(jaccard_join, "links", lambda held, groups: searched.append(groups.count()) or plain(held, groups))
    passage, rows = [f"p{i}" for i in range(30)], []
    for k in range(6):
        words = passage + [f"k{k}w{i}" for i in range(30 * (2**k - 1))]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join([*words, "end"]))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert kept == {0, 2, 4, 6, 8, 10}
    assert searched == [12]
