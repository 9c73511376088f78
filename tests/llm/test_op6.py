import hashlib
import random
from collections import Counter

import numpy as np

from tickloom.llm import op6_fingerprint as op

SCHEMA = "doc_id long, text string, fingerprint string"


def brute(rows):
    rows = sorted([(i, t or "") for i, t in rows], key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    out = []
    for k, (i, t) in enumerate(rows):
        u = rows[(k + 1) % len(rows)][1]
        edited = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        a, b, c = (Counter(op.paragraphs(x)) for x in (t, edited, u))

        def like(x, y):
            same, most = sum((x & y).values()), sum((x | y).values())
            return same / most if most else 1.0

        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), round(like(a, b), 9), round(like(a, c), 9)))
    return sorted(out, key=repr)


def run(spark, rows):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], SCHEMA)
    found = op.fingerprints(docs).collect()
    by_text = {}
    for r in found:
        by_text.setdefault((r.doc_id, r.n_chars), set()).add(r.fingerprint)
    return sorted([(r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in found], key=repr), found


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(op, "PER_BUCKET", 7)
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma.", "delta", "é", "Zeta!", "eta?\n"]
    rows = [(k * 3, " ".join(rng.choices(words, k=rng.choice([0, 1, 5, 40, 900])))) for k in range(60)]
    rows += [(1, None), (2, ""), (400, rows[5][1]), (401, "\n".join(["same line"] * 50))]
    assert run(spark, rows)[0] == brute(rows)
    assert len({r.fingerprint for r in run(spark, [(1, "a. b."), (2, "a. b.")])[1]}) == 1


def test_null_ids_ties_and_one_row(spark, monkeypatch):
    monkeypatch.setattr(op, "PER_BUCKET", 2)
    for rows in ([(None, "x. y"), (4, "p. q. r"), (None, "w"), (4, "o"), (9, "k. l")], [(5, "only. one")], [(None, "only. one")], [(1, "a"), (1, "a"), (1, "a")]):
        assert run(spark, rows)[0] == brute(rows)


def test_empty_table(spark):
    assert run(spark, [])[0] == []


def test_retry_recovers_large_differences():
    a, b = op.Sets([list(range(1, 5000)), [1, 2], []]), op.Sets([list(range(3000, 9000)), [2, 3], []])
    assert op.differences(a, b).tolist() == [2999 + 4000, 2, 0]
    assert np.allclose(op.likeness(a, b), [2000 / 8999, 1 / 3, 1.0])
