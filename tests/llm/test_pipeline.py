"""The pipeline at small size, each stage on what the one before it kept."""

import random
from collections import Counter

import public_tokenizers
import pytest

import corpus_pipeline
from tickloom.llm import common, op1_exact_dedup, op2_minhash, op5_mixing, op7_quality, op9_bpe

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, doc string"


def rows():
    rng = random.Random(21)
    words = ["river", "stone", "of", "the", "morning,", "walks", "children", "quiet", "bridge", "under", "garden", "letter", "window", "answers", "slowly."]
    prose = [" ".join(rng.choices(words, k=rng.randrange(40, 120))) for _ in range(120)]
    out = [(k, t, "en", rng.choice(["a", "b", None]), len(t), "clash") for k, t in enumerate(prose)]
    out += [(500 + k, " ".join(x + "$$$" for x in prose[k].split()), "en", "b", 0, None) for k in range(30)]
    out += [(600 + k, prose[k].upper() if k == 0 else prose[k], "en", "a", 0, None) for k in range(10)]
    out += [(700 + k, prose[20 + k].replace(" ", "  ", 3), "en", "a", 0, None) for k in range(5)]
    out += [(3, "an entirely different text with the id of another document in the table", "en", "b", 0, None), (None, prose[30], "en", "a", 0, None), (None, None, None, None, None, None), (800, prose[40], "en", "b", 0, None), (800, prose[40], "en", "b", 0, None), (801, "", "en", "a", 0, None)]
    return out


@pytest.fixture
def folder(spark, tmp_path):
    spark.createDataFrame(rows(), SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def normal(text):
    return (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def winners(rs, group):
    best = {}
    for r in rs:
        key = (r.doc_id is not None, r.doc_id or 0)
        best[group(r)] = max(best.get(group(r), key), key)
    return Counter((g, k[1] if k[0] else None) for g, k in best.items())


def test_stages_and_run(spark, folder):
    docs = common.table(spark, folder, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    given = docs
    steps = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        given = common.stored(stage(spark, given, folder))
        assert given.columns == docs.columns
        steps.append(given.collect())
    weights, _ = op7_quality.scorer(docs)
    judged = Counter((r.doc_id, r.score) for r in op7_quality.scored(docs, weights).filter("kept").collect())
    assert len(steps[0]) == sum(judged.values()) and not any("$$$" in (r.text or "") for r in steps[0])
    assert any(r.doc_id == 3 and r.text.startswith("an entirely") for r in steps[3])
    # exact: one row for each normalised text, that of the largest id
    assert Counter((normal(r.text), r.doc_id) for r in steps[1]) == winners(steps[0], lambda r: normal(r.text))
    # near: here only texts with the same words are near, as no two others share four fifths of their shingles
    assert Counter((tuple(normal(r.text).split()), r.doc_id) for r in steps[2]) == winners(steps[1], lambda r: tuple(normal(r.text).split()))
    # mix: whole documents, never, once or twice
    times = Counter((r.doc_id, r.text) for r in steps[3])
    assert set(times) <= {(r.doc_id, r.text) for r in steps[2]} and max(times.values()) <= 2 and ("", None) not in times
    got = corpus_pipeline.run(spark, folder).collect()
    coder = op9_bpe.Coder.at(public_tokenizers.path(op9_bpe.RANKS), public_tokenizers.PATTERN)
    assert sorted((r.doc_id is None, r.doc_id, r.ids) for r in got) == sorted((r.doc_id is None, r.doc_id, coder.encoding.encode_ordinary(r.text)) for r in steps[3])


def test_run_leaves_one_table(spark, folder):
    held = set(common._kept)
    corpus_pipeline.run(spark, folder).count()
    assert len(set(common._kept) - held) == 1


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_stages_are_in_the_order_of_the_job():
    assert [s for _, s in corpus_pipeline.STAGES] == [op7_quality.stage, op1_exact_dedup.stage, op2_minhash.stage, op5_mixing.stage, op9_bpe.stage]
