"""The operators on the library's own reports: text keyed by symbol."""

import pytest
from pyspark.sql import functions as F

from barloom.llm import bpe, exact_dedup, jaccard_join, language_model, prefix_trie, substring_dedup, suffix_family
from barloom.llm.queries import word_vocabulary
from barloom.operators.backtest import run_backtest
from barloom.operators.metrics import compare_to_benchmark
from barloom.operators.report import report_sections, report_text, verdict
from barloom.operators.signals import generate_signals
from barloom.operators.target import realised_returns
from tests.frames import to_spark, walk


@pytest.fixture(scope="module")
def sections(spark):
    """Reports of four symbols; two of them are copies of one series, one a near copy."""
    series = {"AAA": walk(120, 1), "BBB": walk(120, 1), "CCC": walk(120, 2), "ÉÉÉ": walk(119, 1)}
    bars = None
    for symbol, pdf in series.items():
        part = to_spark(spark, pdf.assign(symbol=symbol))
        bars = part if bars is None else bars.unionByName(part)
    rows = realised_returns(bars, keys=["symbol"]).withColumn("prediction", F.sin(F.dayofyear("date")))
    comparison = compare_to_benchmark(run_backtest(generate_signals(rows, "prediction", 0.0, True)))
    days = rows.groupBy("symbol", F.month("date").alias("period")).agg(F.count("close").alias("bars"), F.max("close").alias("top"))
    made = report_sections({"verdict": verdict(comparison), "comparison": comparison, "period_sweep": days})
    return made.persist()


@pytest.fixture(scope="module")
def reports(sections):
    return report_text(sections).withColumnRenamed("symbol", "report_id").persist()


def collected(df):
    return {r["report_id"]: r for r in df.collect()}


def test_duplicates_keep_their_symbols(reports):
    exact = collected(exact_dedup.exact_duplicates(reports))
    assert set(exact) == {"AAA", "BBB", "CCC", "ÉÉÉ"}
    assert (exact["BBB"]["keep_id"], exact["BBB"]["group_size"], exact["CCC"]["keep_id"]) == ("AAA", 2, "CCC")
    near = collected(jaccard_join.near_duplicates(reports))
    assert near["BBB"]["component_id"] == "AAA" and near["CCC"]["component_id"] == "CCC"


def test_passages_go_from_later_symbols(reports):
    words = collected(substring_dedup.remove_repeats(reports))
    cut = collected(suffix_family.remove_repeated_bytes(reports))
    assert words["AAA"]["n_removed"] == cut["AAA"]["n_removed"] == 0
    assert cut["BBB"]["n_removed"] == cut["BBB"]["n_bytes"] > 500 and bytes(cut["BBB"]["kept"]) == b""
    assert words["BBB"]["n_removed"] == words["BBB"]["n_words"]
    assert 0 < cut["ÉÉÉ"]["n_removed"] < cut["ÉÉÉ"]["n_bytes"]


def test_tokens_and_scores(reports):
    ids = collected(bpe.round_trip(reports, word_vocabulary()))
    assert bytes(ids["AAA"]["token_ids"]) == bytes(ids["BBB"]["token_ids"]) != bytes(ids["CCC"]["token_ids"])
    scored = collected(language_model.score_reports(reports.withColumn("learn", F.col("report_id") != "CCC")))
    assert scored["AAA"]["score"] == scored["BBB"]["score"] > scored["CCC"]["score"]


def test_trie_of_sections(sections):
    parts = prefix_trie.report_parts(sections)
    numbered = parts.withColumn("report_id", F.expr("array_position(array('AAA', 'BBB', 'CCC', 'ÉÉÉ'), symbol)"))
    nodes, ends = prefix_trie.prefix_trie(numbered)
    assert {(r["report_id"], r["node_report_id"]) for r in ends.collect()} >= {(1, 1), (2, 1), (3, 3)}
    root = nodes.where("depth = 0").first()
    assert root["n_reports"] == 4 and root["saved_chars"] > 0


def test_null_keys_stay_null(spark):
    rows = [("b", "same text here"), ("a", "same text here"), (None, "same text here"), (None, None)]
    df = spark.createDataFrame(rows, "report_id string, report string").withColumn("key", F.lit(1))
    kept = exact_dedup.exact_duplicates(df).collect()
    assert len(kept) == 4 and sum(r["report_id"] is None for r in kept) == 2
    assert {r["keep_id"] for r in kept if r["group_size"] == 3} <= {"a", None}
