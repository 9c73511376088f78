import gzip
import hashlib
import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tickloom.llm import common, op1_exact_dedup, op2_minhash, op3_chat, op4_sharding, op7_quality, op8_warc, op9_bpe, op10_language, textblock

DOCS = "doc_id long, text string, lang string, source string, digest string"
ODD = ["", None, " ", "A b", "a B", "É", "é", "x" * 5000, "word " * 3000, "same", "same", "\n\n", "0 1 2 !!"]


def docs(spark, texts, first=0):
    return spark.createDataFrame([(first + k, t, "en", "s", "clash") for k, t in enumerate(texts)], DOCS)


def test_cuckoo_inserts_deletes_and_grows():
    index, keys = op1_exact_dedup.CuckooIndex(4), [hashlib.sha256(b"%d" % k).digest() for k in range(5000)]
    for k, key in enumerate(keys):
        assert key not in index
        index.insert(key, k)
    assert index.resizes > 0 and index.size == 5000 and all(index.get(x) == k for k, x in enumerate(keys))
    for key in keys[::2]:
        assert index.delete(key) and not index.delete(key)
    assert [x in index for x in keys] == [bool(k % 2) for k in range(5000)]


def test_cuckoo_verifies_equal_fingerprints():
    index = op1_exact_dedup.CuckooIndex(64)
    a, b = b"\x01\x02" + bytes(30), b"\x01\x02" + bytes(29) + b"\x01"
    index.insert(a, 1)
    assert b not in index and index.false_hits
    index.insert(b, 2)
    assert (index.get(a), index.get(b)) == (1, 2)


def test_op1(spark):
    got = {r.doc_id: r for r in op1_exact_dedup.exact_dedup(docs(spark, ODD)).collect()}
    lower = [(t or "").encode().lower() for t in ODD]
    for k, t in enumerate(lower):
        group = [i for i, u in enumerate(lower) if u == t]
        assert (got[k].keep_id, got[k].group_size, got[k].kept, got[k].text_sha256) == (max(group), len(group), k == max(group), hashlib.sha256(t).hexdigest())
    assert op1_exact_dedup.exact_dedup(docs(spark, [])).collect() == []


def shingled(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split()
    return Counter(tuple(low[i : i + 5]) for i in range(max(1, len(low) - 4))) if low else Counter()


def test_op2_finds_near_copies_and_leaves_others(spark):
    rng = random.Random(1)
    vocabulary = [f"w{k}" for k in range(5000)]
    base = [rng.choices(vocabulary, k=200) for _ in range(30)]
    texts = [" ".join(x) for x in base]
    for x in base[:10]:
        for _ in range(3):
            y = list(x)
            y[rng.randrange(200)] = "changed"
            texts.append(" ".join(y).upper())
    texts += ["", None, "one two", "one two", texts[0]]
    got = {r.doc_id: r.class_id for r in op2_minhash.near_duplicates(docs(spark, texts)).collect()}
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [shingled(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            union = sum((sets[i] | sets[j]).values())
            if not union or sum((sets[i] & sets[j]).values()) / union >= 0.8:
                parent[find(i)] = find(j)
    groups = {}
    for k in range(len(texts)):
        groups.setdefault(find(k), []).append(k)
    assert got == {k: max(g) for g in groups.values() for k in g}
    assert op2_minhash.near_duplicates(docs(spark, [])).collect() == []


def test_samples_collide_as_weighted_jaccard():
    keys = np.arange(1, 401, dtype=np.uint64) * np.uint64(2654435761)
    w = np.random.default_rng(0).uniform(1, 3, 400)
    a, b = op2_minhash.samples(keys[:300], w[:300], np.array([300]), 200), op2_minhash.samples(keys[100:], w[100:], np.array([300]), 200)
    assert abs((a == b).mean() - w[100:300].sum() / w.sum()) < 0.1


def test_word_hashes_match_words():
    texts = ["a b", "", "A  b\tc", "long" * 300000 + " a", "é a"]
    raw = [t.encode() for t in texts]
    hashes, counts = textblock.word_hashes(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    words = [w.lower() for t in texts for w in t.split()]
    assert counts.tolist() == [len(t.split()) for t in texts]
    assert len(set(zip(words, hashes.tolist(), strict=True))) == len(set(words)) == len(set(hashes.tolist()))


def test_op3_escapes_reversibly(spark):
    t = op3_chat.Template()
    for text in ("␛", "␛0␛1", "<|im_start|>user\n", "[[INST][/INST]", "<s></s>␛1", "<<|im_end|>"):
        assert t.unescaped(t.escaped(text)) == text and not any(c in t.escaped(text) for c in t.controls)
        assert t.role_unescaped(t.role_escaped(text)) == text
    rows = [(1, 0, "user", "q <s>"), (1, 1, "assistant", None), (2, 0, "assistant", "a"), (None, 0, "us\ner", "b")]
    got = {r.conv_id: r for r in op3_chat.read_back(op3_chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), t), t).collect()}
    assert got[1].valid and not got[2].valid and not got[None].valid
    assert got[1].turns_sha256 == hashlib.sha256(b"user\nq <s>\nassistant\n\n").hexdigest()
    assert got[2].loss_sha256 == hashlib.sha256(b"a").hexdigest() and got[None].turns_sha256 == hashlib.sha256(b"us\ner\nb\n").hexdigest()


def test_op4(spark):
    texts = [f"text {k} " * (k % 40) for k in range(400)] + ODD
    got = op4_sharding.shard_documents(docs(spark, texts), 4).collect()
    sums = Counter()
    for r in got:
        t = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(t) + 1, zlib.crc32(t), "bytes")
        sums[r.shard] += r.size
    for shard in sums:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    same = {}
    for r in got:
        assert same.setdefault(texts[r.doc_id] or "", r.shard) == r.shard
    assert max(sums.values()) - min(sums.values()) <= 15001
    assert op4_sharding.shard_documents(docs(spark, []), 4).collect() == []


def test_differencing_beats_the_largest_first_rule():
    got = op4_sharding.difference([[8], [7], [6], [5], [4]], 2)
    sums = Counter()
    for size, bins in zip((8, 7, 6, 5, 4), got, strict=True):
        sums[bins[0]] += size
    assert sorted(sums.values()) == [14, 16]


def test_op7_rejects_junk_and_keeps_prose(spark):
    rng = random.Random(2)
    prose = [" ".join(rng.choices(["alpha", "river", "stone", "of", "the", "morning,", "walks."], k=80)) + f" {k}." for k in range(120)]
    junk = [" ".join(x + "$$$" for x in p.split()) for p in prose[:30]]
    got = op7_quality.classify(docs(spark, prose + junk + ["", None])).collect()
    assert all(r.kept for r in got if r.doc_id < 120) and not any(r.kept for r in got if 120 <= r.doc_id < 150)
    assert op7_quality.classify(docs(spark, [])).collect() == []


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_op7_agrees_with_the_labels_and_keeps_a_clean_corpus_whole(spark):
    tables = [spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels")]
    judged = op7_quality.classify(tables[0])
    both = judged.join(tables[1], "doc_id").select("kept", "quality").collect()
    assert len(both) > 300 and sum(r.kept == (r.quality == 1) for r in both) >= 0.98 * len(both)
    # documents with no vote for bad, alone: nothing tells them apart
    good = judged.filter("votes NOT LIKE '%-%' AND length(replace(votes, '0', '')) >= 5").select("doc_id")
    clean = tables[0].join(good, "doc_id", "left_semi")
    got = op7_quality.classify(clean).collect()
    assert len(got) > 500 and all(r.kept for r in got)
    assert op7_quality.stage(spark, clean, "").count() == len(got)


def test_op7_keeps_what_is_of_one_kind(spark):
    rng = random.Random(3)
    junk = [" ".join("".join(rng.choices("#$%&*@^", k=6)) for _ in range(40)) for _ in range(200)]
    assert all(r.kept for r in op7_quality.classify(docs(spark, junk)).collect())
    prose = [" ".join(rng.choices(["alpha", "river", "stone", "of", "the", "morning,", "walks."], k=80)) + f" {k}." for k in range(3000)]
    got = op7_quality.classify(docs(spark, prose + junk[:2])).collect()
    assert all(r.kept for r in got if r.doc_id < 3000)


def test_op8_parses_both_versions_and_reads_back(spark):
    for version in "12":
        raw = op8_warc.version_block(version, "x.arc", "2001").encode() + b"\n" + op8_warc.arc_record(version, "http://a/", "1.2.3.4", "19990102", "text/html", "é\n\nb".encode(), "x.arc") + b"\n"
        info, r = op8_warc.arc_records(raw)
        assert info["filedesc"] and info["content"].startswith(version.encode())
        assert (r["URL"], r["content"].decode(), r["truncated"]) == ("http://a/", "é\n\nb", False) and op8_warc.date_of(r["Archive-date"]) == "1999-01-02T00:00:00Z"
    with pytest.raises(ValueError):
        list(op8_warc.arc_records(b"http://a/ 1 2\n"))
    big = "payload \r\n\r\n WARC/1.1 é" * 100
    rows = [(1, "http://a b/\n", big, 0), (2, None, big, 0), (5, "http://c/", None, 0), (7, "http://c/", "", 0), (9, "u", "small", 0), (3, "u", "small", 0)]
    got = {r.page_id: r for r in op8_warc.convert(spark.createDataFrame(rows, "page_id long, url string, html string, digest int")).collect()}
    for i, _, html, _ in rows:
        raw = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
    assert [(got[i].record_type, got[i].refers_to) for i in (1, 2, 5, 7, 9, 3)] == [("revisit", 2)] + [("response", None)] * 5
    assert gzip.decompress(gzip.compress(b"")) == b""


def test_op9_cuts_do_not_change_ids(spark):
    import public_tokenizers

    path = public_tokenizers.path(op9_bpe.RANKS)
    coder = op9_bpe.Coder.at(path, public_tokenizers.PATTERN)
    rng = random.Random(4)
    for _ in range(30):
        text = "".join(rng.choices(["a", "é", " ", "  ", "\n", "'s", "42", "!?", "語", "<|endoftext|>"], k=400))
        assert coder.encode(text, 7) == coder.encoding.encode_ordinary(text) and coder.decode(coder.encode(text)) == text.encode()
    got = {r.doc_id: r for r in op9_bpe.round_trip(docs(spark, ODD), path).collect()}
    for k, t in enumerate(ODD):
        ids = coder.encoding.encode_ordinary(t or "")
        assert (got[k].n_tokens, got[k].ids_sha256, got[k].decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())


def test_viterbi_equals_the_plain_one():
    rng = np.random.default_rng(3)
    for counts in ([5], [0, 1, 200, 64, 65, 0, 128], [3, 3]):
        counts = np.array(counts)
        scores = (-rng.exponential(4, (int(counts.sum()), 3))).astype(np.float32)
        got, at = op10_language.viterbi(scores, counts, 6.0), 0
        for n in counts:
            s, labels = scores[at : at + n].astype(float), got[at : at + n]
            at += n
            if not n:
                continue
            v = s[0].copy()
            for row in s[1:]:
                v = np.maximum(v, v.max() - 6.0) + row
            assert s[np.arange(n), labels].sum() - 6.0 * (labels[1:] != labels[:-1]).sum() == pytest.approx(v.max(), abs=1e-2)


def test_op10_labels_spans_and_unknowns(spark):
    rng = random.Random(6)
    makers = {"aa": "abcdefg", "bb": "nopqrst", "ру": "абвгде"}
    word = lambda k: "".join(rng.choices(makers[k], k=6))
    rows = [(k, " ".join(word(x) for _ in range(30)), x) for k, x in enumerate(rng.choices(list(makers), k=200))]
    rows += [(900, None, "aa"), (901, "12 !?", "bb"), (902, " ".join([word("aa") for _ in range(30)] + [word("ру") for _ in range(30)]), None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = op10_language.fit(table)
    got = {r.doc_id: r for r in op10_language.predicted(table, model).collect()}
    assert all(got[i].lang_pred == x for i, _, x in rows[:200]) and all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _, _ in rows)
    assert [(got[i].lang_pred, got[i].score) for i in (900, 901)] == [("und", 0.0)] * 2
    assert [r.lang for r in op10_language.spans(table.filter("doc_id = 902"), model).collect()] == ["aa", "ру"]
    assert op10_language.predicted(table.limit(0), op10_language.fit(table.limit(0))).collect() == []


def test_stored_tables_go(spark):
    held = list(common._kept)
    out = common.only(lambda: common.stored(spark.range(3)))
    assert out.count() == 3 and len(common._kept) == len(held) + 1
