import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import language_id
from barloom.llm.queries import op4_language_id

SCHEMA = "text_id bigint, text string, lang string"


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    out = op4_language_id(spark, sf)
    assert out.count() == docs.count()
    right, n, low, high = out.join(docs, "doc_id").where("held_out").agg(
        F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count(F.lit(1)), F.min("score"), F.max("score")
    ).first()
    assert right / n >= 0.95 and 0 <= low <= high <= 1


def test_edges(spark):
    english = "the cat and the dog of the house were in the garden with that bird "
    french = "le chat et le chien de la maison étaient dans le jardin avec un oiseau "
    rows = [(i, (english, french)[i % 2] * (1 + i % 5), ("en", "fr")[i % 2]) for i in range(60)]
    rows += [(100, None, "en"), (101, "no label", None)]
    network = language_id.train(spark.createDataFrame(rows, SCHEMA))
    assert network.labels == ["en", "fr"]
    texts = [(1, None), (2, ""), (3, "123 !?"), (4, english * 3000), (5, french), (5, french), (6, "é"), (7, "中")]
    got = language_id.identify(
        spark.createDataFrame([(*t, "x", 2.0) for t in texts], "text_id bigint, text string, lang string, score double"), network
    ).collect()
    assert len(got) == len(texts)
    by = {r.text_id: r.lang for r in got}
    assert by[1] == by[2] == by[3] == "und" and by[4] == "en" and by[5] == "fr" and by[7] in network.labels
    assert all((r.score == 0) == (r.lang == "und") and 0 <= r.score <= 1 for r in got)
    empty = spark.createDataFrame([], SCHEMA)
    assert language_id.train(empty) is None
    assert language_id.identify(empty, network).count() == 0
    assert {r.lang for r in language_id.identify(spark.createDataFrame(rows, SCHEMA), None).collect()} == {"und"}
    one = language_id.train(spark.createDataFrame([(1, "abc", "en")], SCHEMA))
    assert {r.lang for r in language_id.identify(spark.createDataFrame([(2, "xyz", None)], SCHEMA), one).collect()} == {"en"}


@pytest.mark.parametrize("key", [1, None, "own"])
def test_sample_keeps_every_language(spark, key):
    english = [(key if key != "own" else i, f"the cat and dog number {i} went home", "en") for i in range(3000)]
    french = [(i, f"le chat et le chien {i} sont dans la maison", "fr") for i in range(100)]
    same = [(7, "der hund und die katze sind im garten", "de")] * 500
    rows = spark.createDataFrame(english + french + same, SCHEMA)
    network = language_id.train(rows, 300)
    assert network.labels == ["de", "en", "fr"]
    again = language_id.train(rows.orderBy(F.rand(3)), 300)
    assert (again.embed == network.embed).all()
    told = language_id.identify(rows.select("text_id", "text"), network).groupBy("lang").count().collect()
    assert {r["lang"]: r["count"] for r in told} == {"en": 3000, "fr": 100, "de": 500}


def test_pieces_reach_over_the_whole_text(spark):
    texts = [("".join(chr(97 + k) * 500 for k in range(20)),), ("short",), ("z" * 257,)]
    rows = spark.createDataFrame(texts, "text string").select(language_id._pieces("text").alias("p")).collect()
    assert len(rows[0]["p"]) == language_id.SAMPLE_WINDOWS and {len(p) for p in rows[0]["p"]} == {256}
    assert min(rows[0]["p"])[0] <= "e" and max(rows[0]["p"])[-1] >= "p"
    assert rows[1]["p"] == ["short"] and rows[2]["p"] == ["z" * 256]


def _naive(net, window):
    pool = []
    for f in range(net.filters.shape[1]):
        best = -np.inf
        for at in range(language_id.WINDOW - max(language_id.WIDTHS) + 1):
            total = 0.0
            for j in range(max(language_id.WIDTHS)):
                for d in range(language_id.DEPTH):
                    total += net.embed[window[at + j], d] * net.filters[j * language_id.DEPTH + d, f]
            best = max(best, total)
        pool.append(max(best + net.bias[f], 0.0))
    z = np.array(pool) @ net.out + net.out_bias
    e = np.exp(z - z.max())
    return e / e.sum()


def test_network_equals_loops_over_bytes_and_numeric_gradients():
    rng = np.random.default_rng(5)
    net = language_id.Network.fresh(["a", "b", "c"], 1)
    for name in ("embed", "filters", "bias", "out", "out_bias"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    x = rng.integers(1, 256, (2, language_id.WINDOW)).astype(np.uint8)
    x[1, 100:] = 0
    got = net.probabilities(x)
    assert np.abs(got - np.array([_naive(net, w) for w in x])).max() < 1e-6
    target, weight = np.array([2, 0]), np.array([1.0, 0.5])

    def loss():
        return float(-(weight * np.log(net.probabilities(x)[[0, 1], target])).mean())

    arrays = [net.embed, net.filters, net.bias, net.out, net.out_bias]
    for array, slope in zip(arrays, language_id.gradients(net, x, target, weight)):
        flat, steep = array.reshape(-1), slope.reshape(-1)
        for i in np.argsort(-np.abs(steep))[:4]:
            was = flat[i]
            flat[i] = was + 1e-5
            up = loss()
            flat[i] = was - 1e-5
            down = loss()
            flat[i] = was
            assert abs((up - down) / 2e-5 - steep[i]) < 1e-4
