from barloom.llm import decontaminate
from barloom.llm.queries import ORACLES, op3_decontamination
from tests.oracle import compare, connect

DOCS, ITEMS = "doc_id bigint, text string", "item_id bigint, text string"


def run(spark, docs, items, more=""):
    extra = (7, "x") if more else ()
    out = decontaminate.contained_items(
        spark.createDataFrame([(*d, *extra) for d in docs], DOCS + more),
        spark.createDataFrame([(*i, *extra) for i in items], ITEMS + more),
    ).collect()
    return sorted(((r.doc_id, r.item_id, r.shared_shingles, r.item_shingles) for r in out), key=str)


def brute(docs, items):
    def grams(w, k):
        return {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}

    out = {}
    for d, dt in docs:
        for i, it in items:
            a, b = (it or "").lower().split(), (dt or "").lower().split()
            if not a:
                continue
            g = grams(a, min(5, len(a)))
            s = len(g & grams(b, min(5, len(a))))
            if 100 * s >= 80 * len(g):
                out[d, i] = max(out.get((d, i), (0, 0)), (s, len(g)))
    return sorted(((d, i, s, n) for (d, i), (s, n) in out.items()), key=str)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    assert compare(spark, connect(sf), "op3", op3_decontamination, ORACLES["op3_decontamination"], sf) == []


def test_edges(spark):
    item = " ".join(f"w{k}" for k in range(30))
    broken = item.split()
    broken[15] = "other"
    worse = list(broken)
    worse[8] = worse[22] = "more"
    docs = [
        (1, None), (2, ""), (3, "filler " * 5000 + item + " filler" * 5000), (4, "a " + " ".join(broken)),
        (5, " ".join(worse)), (6, item.upper()), (7, "Yes no"), (8, "so yes  NO then"), (9, item + " " + item),
        (9, item), (10, " ".join(reversed(item.split()))),
    ]
    items = [(1, item), (2, "yes no"), (3, None), (4, " "), (5, "x"), (6, item), (6, "w1 w2 w3 w4 w5 w6")]
    want = brute(docs, [x for x in items if x != items[-2]])
    got = run(spark, docs, [x for x in items if x != items[-2]])
    assert got == want
    assert run(spark, docs, items[:5], ", k int, mark string") == brute(docs, items[:5])
    assert run(spark, docs, []) == [] and run(spark, [], items) == []
    assert [r[:2] for r in run(spark, docs, items) if r[0] == 9] == [(9, 1), (9, 6)]


def test_rows_without_an_id_are_found(spark):
    item = "one two three four five six seven"
    docs = [(None, "x " + item), (None, "clean"), (1, item + " y"), (2, "clean")]
    got = run(spark, docs, [(5, item), (None, "two three four")])
    assert sorted(got, key=str) == sorted([(None, 5, 3, 3), (1, 5, 3, 3), (None, None, 1, 1), (1, None, 1, 1)], key=str)


def test_every_size_class_is_asked_by_its_own_bound(spark):
    words = [f"w{k}" for k in range(600)]
    items = [(n, " ".join(words[: n + 4])) for n in (1, 2, 3, 9, 40, 150, 500)] + [(1000, "w0"), (1001, "w3 w4")]
    docs = [(n, " ".join(words[:n])) for n in (1, 4, 5, 7, 12, 30, 45, 130, 420, 600)]
    assert run(spark, docs, items) == brute(docs, items)
    marked = spark.createDataFrame(
        [(i, t.split(), min(5, len(t.split()))) for i, t in items], "item bigint, w array<string>, k int"
    ).selectExpr("item", "k", "transform(w, x -> xxhash64(x)) AS marks")
    kept = decontaminate.item_sketches(marked).groupBy("k", "size_class").agg({"bound": "min", "mark": "max"}).collect()
    assert len(kept) > 5 and all(r["min(bound)"] == r["max(mark)"] for r in kept)
