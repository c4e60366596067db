import json
import random

from pyspark.sql import functions as F

from barloom.llm import chat

SCHEMA = "record_id bigint, payload string"


def run(spark, rows, schema=SCHEMA):
    out = chat.format_chats(spark.createDataFrame(rows, schema))
    out = out.withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn(
        "masked", chat.masked_text(F.col("formatted"), F.col("loss_spans"))
    )
    return {r.record_id: r for r in out.collect()}


def test_layouts(spark):
    rows = [
        (1, json.dumps({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]})),
        (2, json.dumps({"conversations": [{"from": "user", "value": "a"}, {"from": "assistant", "value": "b"}]})),
        (3, json.dumps({"prompt": "a", "completion": "b"})),
        (4, json.dumps({"response": "b", "prompt": "a"})),
        (5, json.dumps({"instruction": "a", "output": "b"})),
        (6, json.dumps({"system": "s", "input": "a", "output": "b"})),
    ]
    got = run(spark, rows)
    assert [got[i].layout for i in range(1, 7)] == [x.name for x in chat.LAYOUTS]
    for i in range(1, 6):
        assert [tuple(t) for t in got[i].turns] == [("user", "a"), ("assistant", "b")] and got[i].masked == "b"
    assert [t.role for t in got[6].turns] == ["system", "user", "assistant"]
    assert len({r.fingerprint for r in got.values()}) == 6


def test_odd_records(spark):
    rows = [(1, None), (2, ""), (3, "{"), (4, '{"other": [1]}'), (5, '{"prompt": null, "completion": "x"}'),
            (6, '{"messages": []}'), (7, "[1, 2]"), (7, "[1, 2]")]
    out = chat.format_chats(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == 8
    by = {r.record_id: r for r in out}
    assert all(by[i].layout is None and by[i].formatted == "" and by[i].loss_spans == [] for i in (1, 2, 3, 4, 7))
    assert chat.format_chats(spark.createDataFrame([], SCHEMA)).count() == 0
    extra = chat.format_chats(spark.createDataFrame([(*rows[4], "t", 1)], SCHEMA + ", turns string, v int"))
    assert extra.first().formatted == "<turn user></turn><turn assistant>x</turn>"


def test_any_text_comes_back(spark):
    rng = random.Random(5)
    pool = ["\\", "<", ">", "l", "g", "</turn>", "<turn assistant>", "\n", "é", "🙂", " ", "\\\\", "### Assistant:"]
    rows, want = [], {}
    for i in range(300):
        turns = [
            (rng.choice(["user", "assistant", "a>b"]), "".join(rng.choices(pool, k=rng.randrange(9))))
            for _ in range(rng.randrange(1, 5))
        ]
        want[i] = turns
        rows.append((i, json.dumps({"messages": [{"role": r, "content": t} for r, t in turns]})))
    for i, r in run(spark, rows).items():
        assert [tuple(t) for t in r.turns] == want[i]
        assert r.masked == "".join(t for role, t in want[i] if role == "assistant")


def test_payloads_that_no_variant_takes(spark, tmp_path):
    def repeated(text, n):
        return F.repeat(F.lit(text), F.col("record_id").cast("int") * 0 + n)  # no constant, so that plans stay small

    def message(role, text):
        return F.struct(F.lit(role).alias("role"), text.alias("content"))

    long, many = repeated('ab\\"', 6_250_000), repeated("0123456789", 1_500_000)
    payloads = [
        F.to_json(F.struct(F.array(message("user", F.lit("a")), message("assistant", long)).alias("messages"))),
        F.to_json(F.struct(F.array_repeat(message("assistant", many), 10).alias("messages"))),
        F.to_json(F.struct(long.alias("prompt"), F.lit("b").alias("completion"))),
        F.concat(F.lit('{"prompt": "'), long, F.lit('\\x", "completion": "b"}')),
    ]
    want = [("messages", 2, 25_000_001), ("messages", 10, 150_000_000), ("prompt", 2, 25_000_001), (None, 0, 0)]
    for k, (payload, known) in enumerate(zip(payloads, want)):
        path = str(tmp_path / str(k))
        spark.range(1).select(F.col("id").alias("record_id")).withColumn("payload", payload).write.parquet(path)
        chars = F.expr("aggregate(turns, 0L, (n, t) -> n + length(t.text))")
        assert tuple(chat.canonical_turns(spark.read.parquet(path)).select("layout", F.size("turns"), chars).first()) == known


def test_long_way_reads_what_the_variant_reads(spark, monkeypatch):
    texts = ["", "x", "a\\b\"c", "}{][,:\\", '"role":', "é🙂\n\t", '{"a": ""}', "null", "<turn user>"]
    rows = [json.dumps({"messages": [{"role": r, "content": t} for t in texts for r in ("user", "assistant")]})]
    rows += [json.dumps({"messages": [{"role": "user", "content": "a"}] * 50}, ensure_ascii=a, indent=i) for a in (True, False) for i in (None, 2)]
    rows += [json.dumps({"conversations": [{"value": t, "from": None}, {"from": "assistant"}, None]}) for t in texts]
    rows += [json.dumps({"prompt": t, "completion": u}) for t in texts for u in (None, 1.5, 10, True, "b")]
    rows += ['{"prompt": 1e3, "completion": 1.50}', '{"prompt": "a", "prompt": "b", "completion": "c"}', "", "{", None,
             "{'prompt': 'a', 'completion': 'b'}", '{"prompt": "\\x", "completion": "b"}', '{"prompt": NaN, "completion": "b"}',
             '{"prompt": "a\nb", "completion": "b"}', '{"messages": []}', '{"messages": ["a"]}', '{"messages": "a"}', "[1, 2]", '"a"',
             '{"messages": [{"role": "user", "content": "a", "more": 1}]}', '{"prompt": ["a"], "completion": "b"}',
             '{"messages": [{"role": "user", "content": "a"}, {"role": "user", "content": {"b": "c", "a": [1.0, "d"]}}]}',
             '{"mess\\u0061ges": [{"role": "user", "content": "\\u00e9"}]}', '{"input": "a", "output": "b", "system": null} x']
    frame = spark.createDataFrame(list(enumerate(rows)), SCHEMA)
    want = {r.record_id: r for r in chat.format_chats(frame).collect()}
    monkeypatch.setattr(chat, "PLAIN", -1)
    got = {r.record_id: r for r in chat.format_chats(frame).collect()}
    assert got == want and sum(r.layout is not None for r in want.values()) > 60
