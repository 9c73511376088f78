import random

import pytest

from tickloom.llm import op5_mixing as op

SCHEMA = "doc_id long, text string, source string, taken string"


def rows(n=300, seed=5):
    rng = random.Random(seed)
    out = [(k, " ".join(["w"] * rng.choice([0, 1, 7, 60, 500])), rng.choice(["a", "a", "a", "b", "Z", "é", None]), "clash") for k in range(n)]
    return out + [(n, None, "b", None), (n + 1, "x y\tz", "b", None)]


def sizes(data):
    out = {}
    for _, t, s, _ in data:
        out[s] = out.get(s, 0) + len([w for w in (t or "").replace("\t", " ").split(" ") if w])
    return out


def test_targets_and_taken(spark):
    data = rows()
    got = op.mix(spark.createDataFrame(data, SCHEMA)).collect()
    again = op.mix(spark.createDataFrame(data, SCHEMA).repartition(5)).collect()
    assert sorted(got) == sorted(again) and len(got) == len(data)
    by_id = {x[0]: x[2] for x in data}
    want = sizes(data)
    names = sorted(want, key=lambda s: (s is None, s))
    due = dict(zip(names, op.targets([want[s] for s in names], [(3.0, 1.0, 2.0)[i % 3] for i in range(len(names))]), strict=True))
    assert sum(due.values()) == pytest.approx(1.5 * sum(want.values()))
    for s in names:
        own = [r for r in got if by_id[r.doc_id] == s]
        assert {r.source_size for r in own} == {want[s]} and {round(r.target, 6) for r in own} == {round(due[s], 6)}
        assert abs(sum(r.taken for r in own) - due[s]) <= 2 * op.BLOCK
    assert all(r.taken <= 2 * r.size for r in got)


def test_whole_documents_follow_the_mix(spark):
    data = rows()
    docs = spark.createDataFrame(data, SCHEMA)
    times = {r.doc_id: (2 * r.taken + r.size) // (2 * r.size) for r in op.mix(docs).collect() if r.size}
    out = op.whole_documents(docs)
    assert out.columns == docs.columns
    found = {}
    for r in out.collect():
        found[r.doc_id] = found.get(r.doc_id, 0) + 1
    assert found == {k: v for k, v in times.items() if v}


def test_seats_are_highest_quotients():
    due, caps = [5.0, 3.0, 1.0, 0.0], [50, 2, 50, 50]
    for house in range(30):
        got = [0] * 4
        for _ in range(house):
            i = max((i for i in range(3) if got[i] < caps[i]), key=lambda i: (due[i] / (2 * got[i] + 1), -i))
            got[i] += 1
        assert op.seats(due, caps, house) == got


def test_empty_table(spark):
    assert op.mix(spark.createDataFrame([], SCHEMA)).collect() == []
    assert op.whole_documents(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("seed", [0])
def test_many_sources_are_apportioned_as_few_are(spark, monkeypatch, seed):
    rng = random.Random(seed)
    # equal sizes give equal quotients; some sources have no words
    data = [(k, " ".join(["w"] * rng.choice([0, 40, 40, 40, 90, 1500])), rng.choice([f"s{k % 120:03}", f"é{k % 7}", None])) for k in range(400)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    few = sorted(op.mix(docs).collect())
    monkeypatch.setattr(op, "SOURCES", 3)
    many = sorted(op.mix(docs).collect())
    assert [r.target for r in many] == pytest.approx([r.target for r in few])
    assert [(r.doc_id, r.size, r.source_size, r.taken, r.first_shard) for r in many] == [(r.doc_id, r.size, r.source_size, r.taken, r.first_shard) for r in few]


def test_two_hundred_thousand_sources(spark):
    found = spark.range(200_000).selectExpr("concat('s', lpad(id, 6, '0')) AS source", "CAST(10 + pmod(xxhash64(id), 500) AS LONG) AS words")
    out = op.planned(found, 1, 16, op.BLOCK).toPandas().sort_values("s", ignore_index=True)
    want = op.plan(out.source_size.tolist(), [(3.0, 1.0, 2.0)[i % 3] for i in range(len(out))])
    assert len(out) == 200_000 and out.target.tolist() == pytest.approx(want["targets"])
    assert sum(out.quota) == sum(want["quotas"]) and (out.quota != want["quotas"]).sum() <= 5


@pytest.mark.parametrize("copies", [6, 7])
def test_equal_rows_are_taken_one_by_one(spark, copies):
    data = [(1, " ".join(["w"] * 200), "a", None)] * copies
    docs = spark.createDataFrame(data, SCHEMA).repartition(3)
    due = 1.5 * 200 * copies
    got = op.whole_documents(docs).collect()
    assert abs(200 * len(got) - due) <= 200
    mixed = [(k, " ".join([f"w{k}"] * 50), "b", None) for k in range(40)] + [(None, "x " * 60, "a", None)] * 9 + [(7, "y " * 60, None, None)] * 5
    docs = spark.createDataFrame(mixed, SCHEMA).repartition(4)
    words = {}
    for r in op.mix(docs).collect():
        words[r.target] = words.get(r.target, 0) + r.taken
    out = {}
    for r in op.whole_documents(docs).collect():
        out[r.source] = out.get(r.source, 0) + len(r.text.split())
    for s, due in zip(("a", "b", None), op.targets([540, 2000, 300], [3.0, 1.0, 2.0]), strict=True):
        assert abs(out[s] - due) <= 2 * 60
