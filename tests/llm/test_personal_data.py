import hashlib
import random
import re

from barloom.llm import personal_data
from barloom.llm.queries import op9_personal_data

SCHEMA = "text_id bigint, text string"
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(d):
    total = 0
    for k, c in enumerate(reversed(d)):
        x = int(c) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def valid(kind, piece):
    d = re.sub("[^0-9]", "", piece)
    if kind == "ip":
        return all(int(x) <= 255 for x in piece.split("."))
    if kind == "card":
        return 12 <= len(d) <= 19 and luhn(d)
    return kind == "email" or 9 <= len(d) <= 15


def brute(text):
    return sorted(
        (m.start(), rank, m.end(), kind)
        for rank, (kind, p) in enumerate(PATTERNS.items())
        for m in p.finditer(text or "")
        if valid(kind, m.group())
    )


def test_base_spans_equal_brute_force(spark):
    rng = random.Random(3)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    rows = [tuple(r) for r in docs]
    pool = [*"aB1@..-+ (%)é🙂", "4111 1111 1111 1111", "1.2.3.4", "a@b.co", "+1 (555) 123-4567", "378282246310005",
            "256.1.1.1", "0255.1.1.01", "555-123-4567", "123-45-6789", "GB82WEST12345698765432"]
    rows += [(10**6 + i, "".join(rng.choices(pool, k=rng.randrange(25)))) for i in range(2000)]
    rows += [(1000, None), (1001, ""), (1002, "1 " * 50000), (1003, "a." * 40000 + "@b"), (1004, "x@" + "a." * 30000 + "b"),
             (1005, "4111111111111111 x " * 2000), (1006, "dup a@b.co")]
    rows.append(rows[-1])
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], SCHEMA + ", s int, candidates string")
    out = personal_data.find_personal_data(df).collect()
    assert len(out) == len(rows)
    text = dict(rows)
    for r in out:
        base, spans = [tuple(s) for s in r.base], [tuple(s) for s in r.spans]
        assert base == brute(text[r.text_id])
        assert set(base) <= set(spans) and spans == sorted(spans)
        assert all(s[3] == "other" for s in set(spans) - set(base))


def test_nothing_to_learn_from(spark):
    out = personal_data.find_personal_data(spark.createDataFrame([(1, "no data here"), (2, None)], SCHEMA)).collect()
    assert [(r.base, r.spans) for r in out] == [([], [])] * 2
    assert personal_data.find_personal_data(spark.createDataFrame([], SCHEMA)).count() == 0


def test_em_ranks_labelers():
    """A labeler that agrees with the others is trusted more than one that votes at random."""
    patterns = {(1, 1, 1, 0, 1): 300, (-1, -1, 0, -1, -1): 300, (1, 1, 0, 0, -1): 150, (-1, -1, 0, -1, 1): 150}
    post, tables = personal_data.reliabilities(patterns)
    assert post[1, 1, 1, 0, 1] > 0.95 and post[-1, -1, 0, -1, -1] < 0.05
    assert tables[0][1][0] - tables[0][1][1] > tables[4][1][0] - tables[4][1][1]


def test_query_digests(spark):
    sf = "/root/testdata/sf0.001"
    text = dict(tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    out = op9_personal_data(spark, sf)
    assert out.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    rows = out.collect()
    assert len(rows) == 200 and any(r.spans for r in rows)
    for r in rows:
        base = [f"{k}:{a}:{b}" for a, _, b, k in brute(text[r.doc_id])]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s and not s.startswith("other:")] == base
        counts = [sum(b.startswith(k) for b in base) for k in PATTERNS]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts
