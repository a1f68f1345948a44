"""Text operators against brute force, libraries, and odd rows."""

import hashlib
import json
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewatch.llm import bpe, langid, licenses, mixing, neardup, suffixlm, textvec, tokencount, toxicity
from tidewatch.llm.common import sample_by

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", "   \n\t", "a", "Ünïcödé wörds ñ 日本語 🙂", "x" * 5000, "the " * 30_000, "\x00\x1f!!! ...", "MIT License MIT  license\nmit-license"]


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def frame(spark, texts, **extra):
    rows = [(k, t, "en", f"s{k % 3}", len(t or "")) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA)
    for name, value in extra.items():
        df = df.withColumn(name, F.lit(value))
    return df


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").cache()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("aAbZ \t\n.,0é日ß"), max_size=30) | st.none(), min_size=1, max_size=6))
def test_words_of_arrow_buffers(texts):
    col = pa.array(texts, pa.string())
    for table, pattern in ((textvec.NOT_SPACE, WORD), (textvec.ALNUM, ALNUM_WORD)):
        got = textvec.words_of(col, table)
        want = [pattern.findall((t or "").translate(LOWER)) for t in texts]
        assert got.counts.tolist() == [len(w) for w in want]
        flat = [w.encode() for ws in want for w in ws]
        assert [got.word(k) for k in range(len(got))] == flat
        assert got.hash.tolist() == [textvec.hash_bytes(w) for w in flat]


def test_words_of_one_pattern_and_its_complement_differ():
    """Polynomials modulo a power of two take these for equal at 1024 bytes, whatever the base."""
    a = b"a"
    for _ in range(12):
        a += bytes(0x61 + 0x62 - c for c in a)
    for n in (256, 1024, 4096):
        x = a[:n].decode()
        y = x.translate(str.maketrans("ab", "ba"))
        h = textvec.words_of(pa.array([f"{x} {y} {x}"])).hash
        assert h[0] == h[2] != h[1] and int(h[0]) == textvec.hash_bytes(x.encode())


def test_hashes_of_many_words_differ():
    many = [f"{k:x}" for k in range(200_000)]
    assert len(np.unique(textvec.words_of(pa.array([" ".join(many)])).hash)) == len(many)


def test_hash_index():
    keys = textvec.mix(np.arange(1000, dtype=np.uint64))
    index = textvec.HashIndex(keys)
    assert index.find(keys).tolist() == list(range(1000))
    assert (index.find(textvec.mix(np.arange(5000, 6000, dtype=np.uint64))) == -1).all()
    assert (textvec.HashIndex(keys[:0]).find(keys) == -1).all()


@pytest.mark.parametrize("keys", [[0, 1, 2, 3, 1 << 63, (1 << 64) - 1], [5, 3, 4, 1 << 40, 2], [7], list(range(1, 300)), list(range(300, 0, -1))])
def test_hash_index_of_sorted_and_crowded_keys(keys):
    """Sorted keys are their own order; keys that share a bucket are all found, others in it and beyond none."""
    keys = np.array(keys, np.uint64)
    index = textvec.HashIndex(keys)
    assert index.find(keys[::-1]).tolist() == list(range(len(keys)))[::-1]
    others = np.setdiff1d(np.array([0, 1, 2, 6, 1000, (1 << 40) + 1, (1 << 63) - 1, (1 << 64) - 2], np.uint64), keys)
    assert (index.find(others) == -1).all()


def test_block_hashes():
    """Equal for equal words whatever their place, of any size, and different for any others, padding and NULs included."""
    rng = np.random.default_rng(3)
    top = textvec.BLOCKED
    distinct = {bytes(rng.integers(33, 127, n, dtype=np.uint8)) for n in [*range(1, 40), top - 1, top, top + 1, 3 * top] for _ in range(20)}
    distinct |= {b"a" * n for n in range(1, 200)} | {b"\0" * n for n in range(1, 40)} | {b"a" + b"\0" * n for n in range(20)} | {b"x" * top + b"a", b"x" * top + b"b", b"x" * (top - 1) + b"a"}
    texts = [w.decode() for w in sorted(distinct) for _ in range(2)]
    rng.shuffle(texts)
    words = textvec.words_of(pa.array([" ".join(texts[:300]), "", *texts[300:-1], None, texts[-1]]), lower=False, hashed=False)
    seen = {}
    for k, h in enumerate(textvec.block_hashes(words).tolist()):
        seen.setdefault(words.word(k), set()).add(h)
    assert len(seen) == len(distinct) and all(len(h) == 1 for h in seen.values()) and len(set().union(*seen.values())) == len(distinct)
    assert len(textvec.block_hashes(textvec.words_of(pa.array(["", None], pa.string()), hashed=False))) == 0


# -- encoding -------------------------------------------------------------------------------------


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.tokenizer_path())


ADVERSARIAL = [*ODD, "héllo ’s it's <|endoftext|>x <|startoftext|>", "a\x1cb\u0085c　d", "İstanbul ΑΣ ǅ é ́x ﬁ ½ ² 一二", "aaaa" * 300, "don'T we'LL i'm 's''s", "<|x <|ENDOFTEXT|>", "​x﻿y", "힣 가각", "à́b"]


def test_encoding_equals_the_library():
    t, b = library(), bpe.SpeculativeBpe(bpe.tokenizer_path())
    for text, (ids, n, decoded) in zip(ADVERSARIAL, b.encode_batch(ADVERSARIAL), strict=True):
        want = t.encode(text or "", add_special_tokens=False).ids
        assert ids == " ".join(map(str, want)) and n == len(want)
        assert decoded == t.decode(want, skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=40))
def test_encoding_any_text(text):
    b = bpe.encoder(bpe.tokenizer_path())
    global _LIB
    if "_LIB" not in globals():
        _LIB = library()
    want = _LIB.encode(text, add_special_tokens=False).ids
    assert b.encode_batch([text])[0][0] == " ".join(map(str, want))


def test_added_tokens_of_another_file(tmp_path):
    with open(bpe.tokenizer_path(), encoding="utf-8") as f:
        spec = json.load(f)
    for token, name in zip(spec["added_tokens"], ("[start]", "{end}"), strict=True):
        token["content"] = name
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    b = bpe.SpeculativeBpe(str(path))
    assert list(b.segments("a[start]b {end}")) == [(False, "a"), (True, "[start]"), (False, "b "), (True, "{end}")]
    assert list(b.segments("<|endoftext|>")) == [(False, "<|endoftext|>")]


def test_encoding_forgets_and_stays_right(monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY_WORDS", 8)
    t, b = library(), bpe.SpeculativeBpe(bpe.tokenizer_path())
    for _ in range(3):
        for text in ("some words that fill it up quickly", "others come and some go", "again others and more words here " * 3):
            assert b.encode_batch([text])[0][0] == " ".join(map(str, t.encode(text, add_special_tokens=False).ids))


def test_encoding_query(spark, sf, docs):
    t = library()
    got = {r["doc_id"]: r for r in bpe.query(spark, sf).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids
        assert got[r["doc_id"]]["n_tokens"] == len(ids)
        assert got[r["doc_id"]]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[r["doc_id"]]["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_encoding_clashing_columns_and_empty_table(spark):
    df = frame(spark, ["one two", None], ids="old", n_tokens="old")
    out = bpe.encode_decode(df).orderBy("doc_id").collect()
    assert out[0]["n_tokens"] == 2 and out[1]["ids"] == [] and out[1]["decoded"] == ""
    assert bpe.encode_decode(df.limit(0)).count() == 0


def test_token_counts_equal_the_library():
    from tokenizers import Tokenizer, models

    vocab, unk = tokencount.unigram_vocabulary()
    t, c = Tokenizer(models.Unigram(vocab, unk, byte_fallback=True)), tokencount.ViterbiCounter(vocab, unk)
    texts = [*ADVERSARIAL, "ᚠᚡᚢ x꙳y", "<unk> <s> <0x41> ▁▁"]
    want = [sum(len(t.encode(tokencount.MARK + w, add_special_tokens=False).ids) for w in (x or "").split()) for x in texts]
    assert c.count_batch(texts) == want


def test_token_count_ties_and_unknowns():
    c = tokencount.ViterbiCounter([("<unk>", 0.0), ("a", -1.0), ("aa", -2.0), ("b", -1.0), ("ab", -2.0)], 0)
    from tokenizers import Tokenizer, models

    t = Tokenizer(models.Unigram([("<unk>", 0.0), ("a", -1.0), ("aa", -2.0), ("b", -1.0), ("ab", -2.0)], 0, byte_fallback=False))
    for word in ("aa", "aaa", "aab", "abab", "xxa", "axxb", "xyzzy"):
        assert c.count(word) == len(t.encode(word, add_special_tokens=False).ids), word


def test_token_count_rows(spark, sf):
    df = frame(spark, ["one two", None, "one two"], n_tokens="old")
    n = tokencount.ViterbiCounter(*tokencount.unigram_vocabulary()).count_batch(["one two"])[0]
    assert [r["n_tokens"] for r in tokencount.count(df).orderBy("doc_id").collect()] == [n, 0, n]
    assert tokencount.count(df.limit(0)).count() == 0
    odd = tokencount.count(frame(spark, ODD)).orderBy("doc_id").collect()
    assert [r["n_tokens"] for r in odd][:3] == [0, 0, 0] and odd[6]["n_words"] == 30_000 and odd[6]["n_tokens"] == 30_000 * tokencount.ViterbiCounter(*tokencount.unigram_vocabulary()).count_batch(["the"])[0]
    assert tokencount.query(spark, sf).count() == spark.read.parquet(f"{sf}/documents.parquet").count()


# -- near-duplicates ------------------------------------------------------------------------------


def shingles(text):
    w = words(text)
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows, threshold=85):
    ids = sorted({i for i, _ in rows if i is not None})
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    parent = {i: i for i in ids}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for x, (i, a) in enumerate(sets):
        for j, b in sets[x + 1 :]:
            if a and b and 100 * len(a & b) >= threshold * len(a | b):
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def near_texts():
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in rng.integers(0, 500, 300)]
    out = []
    for k in range(60):  # a large group of near copies, at all similarities
        w = list(base)
        for at in rng.integers(0, len(w), k % 13):
            w[at] = f"x{k}_{at}"
        out.append(" ".join(w))
    passage = " ".join(base[:60])
    out += [passage + " " + " ".join(f"u{k}_{j}" for j in range(200)) for k in range(20)]  # one passage in many texts
    out += [out[0].upper(), out[0].replace(" ", "\n"), "one two three", "One  two three", "one two three four", "", None, " "]
    return out


def test_near_duplicates_equal_brute_force(spark, sf, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want = brute_components(rows)
    got = neardup.query(spark, sf).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["component_id"] == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == want[r["doc_id"]])


def test_words_are_proposed_and_merged_together(monkeypatch):
    """Many pre-tokens at once give what one at a time gives, and only long ones are merged by themselves."""
    b, rng = bpe.SpeculativeBpe(bpe.tokenizer_path()), np.random.default_rng(3)
    words = ["".join(rng.choice(list("theaionrsdlé日'"), rng.integers(1, 40))) for _ in range(400)] + ["a", "é", "x" * 64, "x" * 65, "日" * 40]
    symbols = ["".join(map(b.symbol.__getitem__, w.encode())) for w in words]
    one = [b.merge([*(b.vocab[c] for c in w[:-1]), b.vocab[w[-1] + b.suffix]]) for w in symbols]
    short = [w for w, x in zip(words, symbols, strict=True) if len(x) <= bpe.LONGEST_TOGETHER]
    end = np.cumsum([len(w.encode()) for w in short])
    ids, sizes = b.propose_many(np.frombuffer("".join(short).encode(), np.uint8), end - [len(w.encode()) for w in short], end)
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [b.propose(x) for x in symbols if len(x) <= bpe.LONGEST_TOGETHER]
    alone, merge = [], b.merge
    monkeypatch.setattr(b, "merge", lambda ids: alone.append(len(ids)) or merge(ids))
    ids, sizes = b.encode_words(words)
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == one
    assert all(n > bpe.LONGEST_TOGETHER for n in alone)


def test_bands_follow_from_the_threshold():
    assert (neardup.banding(85), neardup.banding(80)) == ((24, 6), (29, 5))
    for t in range(50, 100):
        bands, rows = neardup.banding(t)
        assert (1 - (t / 100) ** rows) ** bands <= neardup.MISSED or rows == 1
    assert (neardup.fine_banding(85), neardup.fine_banding(80)) == ((30, 7), (38, 6))
    for t in range(50, 100):
        bands, rows = neardup.fine_banding(t)
        assert bands * rows <= neardup.SAMPLES and (1 - (t / 100) ** rows) ** bands <= neardup.MISSED


@pytest.mark.parametrize("threshold", [80, 85])
def test_hot_buckets_of_unlinked_texts(spark, monkeypatch, threshold):
    """Hundreds of texts that share most of a text, yet are linked with few: all links are found, in cells of finer bands."""
    monkeypatch.setattr(neardup, "HOT_ROWS", 50)
    monkeypatch.setattr(neardup, "CELL_ROWS", 16)
    rng = np.random.default_rng(5)
    shared, texts = [f"s{k}" for k in range(160)], []
    for k in range(600):
        own = rng.integers(14, 32)
        texts.append(" ".join(shared + [f"o{k}_{j}" for j in range(own)]))
        if k % 20 == 0:  # a partner that shares what is its own too
            texts.append(texts[-1] + " " + " ".join(f"p{k}_{j}" for j in range(rng.integers(1, 20))))
    rows = list(enumerate(texts))
    want = brute_components(rows, threshold)
    got = neardup.link(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), threshold=threshold).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert 30 < len(set(want.values())) < len(rows)


def test_near_duplicates_take_few_tasks(spark, monkeypatch):
    """However many partitions shuffles have and however small the slices of skewed ones are, small tables take few tasks and pairs are not sliced on both sides."""
    monkeypatch.setattr(neardup, "HOT_ROWS", 50)
    monkeypatch.setattr(neardup, "CELL_ROWS", 16)
    hot = {"shuffle.partitions": "40", "adaptive.coalescePartitions.enabled": "false", "adaptive.advisoryPartitionSizeInBytes": "16k", "adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "adaptive.skewJoin.skewedPartitionFactor": "1.5"}
    shared = " ".join(f"s{k}" for k in range(160))
    rows = [(k, shared + " " + " ".join(f"o{k}_{j}" for j in range(14 + k % 18))) for k in range(300)]
    df, before = spark.createDataFrame(rows, "doc_id long, text string").repartition(4), {f"spark.sql.{k}": spark.conf.get(f"spark.sql.{k}") for k in hot}
    try:
        for k, v in hot.items():
            spark.conf.set(f"spark.sql.{k}", v)
        spark.sparkContext.setJobGroup("few", "few")
        got = neardup.link(df).collect()
        tracker = spark.sparkContext.statusTracker()
        stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("few") for s in tracker.getJobInfo(j).stageIds]
        tasks = [x.numCompletedTasks for x in stages if x]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(got) == len(rows) and {r["doc_id"]: r["component_id"] for r in got} == brute_components(rows, neardup.THRESHOLD)
    assert max(tasks) <= 120 and sum(tasks) < 2_400


@pytest.mark.parametrize(("hot", "sent", "cell"), [(1000, 400_000, 512), (8, 400_000, 512), (8, 0, 2)])
def test_near_duplicates_of_hard_rows(spark, monkeypatch, hot, sent, cell):
    monkeypatch.setattr(neardup, "HOT_ROWS", hot)
    monkeypatch.setattr(neardup, "SENT_BUCKETS", sent)
    monkeypatch.setattr(neardup, "CELL_ROWS", cell)
    texts = near_texts()
    rows = list(enumerate(texts)) + [(3, texts[3]), (4, "a text of its own that shares nothing with others here"), (None, texts[0])]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, kept int")
    want = brute_components(rows)
    got = neardup.link(df, threshold=85).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert r["component_id"] == want[r["doc_id"]], r
    counts = {r["doc_id"]: r["n_shingles"] for r in got}
    assert all(counts[i] == len(shingles(t)) for i, t in enumerate(texts) if i not in (3, 4))
    stay = neardup.deduplicated(df, threshold=85)
    assert stay.columns == df.columns
    ids = [r["doc_id"] for r in stay.select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None) == sorted({c for i, c in want.items()}) and ids.count(None) == 1


def test_near_duplicates_empty_table(spark):
    assert neardup.link(frame(spark, ["a"]).limit(0)).count() == 0
    assert neardup.deduplicated(frame(spark, ["a"]).limit(0)).count() == 0


def test_near_duplicates_of_very_long_texts(spark):
    long = " ".join(f"w{k % 7919}" for k in range(60_000))
    df = spark.createDataFrame([(1, long), (2, long + " and more"), (3, "x" * 300_000), (4, "x" * 300_000)], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in neardup.link(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 3}


def test_odd_sketch_estimates():
    rng = np.random.default_rng(0)
    for same in (0.95, 0.85, 0.6):
        a = rng.integers(0, 1 << 32, (neardup.SAMPLES, 200), dtype=np.uint32)
        b = np.where(rng.random(a.shape) < same, a, rng.integers(0, 1 << 32, a.shape, dtype=np.uint32))
        bits = np.unpackbits((neardup.odd_sketches(a) ^ neardup.odd_sketches(b)).view(np.uint8), axis=1).sum(1)
        if same >= 0.85:
            assert (bits <= neardup.sketch_limit(85)).all()
        else:
            assert (bits > neardup.sketch_limit(85)).mean() > 0.99


# -- licenses -------------------------------------------------------------------------------------


def test_licenses(spark, sf, docs):
    def base(text):
        w = ALNUM_WORD.findall((text or "").translate(LOWER))
        at = [(k, label) for p, label in licenses.BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        return len(w), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None), ",".join(sorted({x for _, x in at}))

    for df in (docs, frame(spark, ODD, labels="old")):
        for r in licenses.scan(df).join(df.select("doc_id", "text"), "doc_id").collect():
            assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == base(r["text"])
            assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
            assert 0 <= r["score"] <= 1


def test_fuzzy_notices(spark):
    text = "intro\n# Permision is hereby granted, free of charge,\n# to any persn obtaining a copy\nend. Redistribution and use in sorce and binary forms"
    row = licenses.scan(frame(spark, [text])).first()
    assert row["labels"] == "bsd,mit" and row["base_labels"] == "" and row["score"] == 0.75
    span = next(s for s in row["spans"] if s["label"] == "mit")
    assert (span["start_word"], span["end_word"], span["edits"]) == (1, 14, 2)
    assert licenses.scan(frame(spark, ["clean prose about nothing at all"])).first()["labels"] == ""


@settings(max_examples=40, deadline=None)
@given(st.data())
def test_every_edit_within_the_bound_is_found(data):
    search = licenses.NoticeSearch(licenses.NOTICES)
    k = data.draw(st.integers(0, len(search.notices) - 1))
    notice, _, errors = search.notices[k]
    text = list(notice)
    marked = list(licenses.NOTICES)[k]
    inside = np.cumsum([(c == "{") - (c == "}") for c in marked])
    free = [j for j, c in enumerate(i for i, c in zip(inside, marked, strict=True) if c not in "{}") if not c and text[j] != " "]
    for _ in range(data.draw(st.integers(0, errors))):
        text[data.draw(st.sampled_from(free))] = data.draw(st.sampled_from("xyz"))
    found = search.matches("some words before " + "".join(text) + " and after")
    assert any(f[0] == k for f in found)


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("released under the bsd license", "bsd"),
        ("Released under the ISC license.", "isc"),
        ("released under the gpl license", "gpl"),
        ("released under the mit license", "mit"),
        ("relesed under the mit licence", "mit"),
        ("released under the tit license", ""),
        ("a small rights reserved", ""),
        ("call rights reserved", ""),
        ("All rights reserved", "all-rights-reserved"),
        ("creative commons attribution 4.0", "cc-by"),
        ("Creative Commons Attribution-NonCommercial 4.0", "cc-by-nc"),
        ("Creative Commons Attribution-ShareAlike", "cc-by-sa"),
        ("creative comons attribution share alike", "cc-by-sa"),
        ("Creative Commons Attribution-NonCommercial-ShareAlike 4.0", "cc-by-nc-sa"),
        ("creative commons attribution noncommercial no derivatives", "cc-by-nc-nd"),
        ("GNU Lesser General Public License", "lgpl"),
        ("GNU Affero General Public License", "agpl"),
        ("gnu genral public license", ""),
        ("gnu general pubic license", "gpl"),
        ("preacquired lands reserved; the permit license plate", ""),
    ],
)
def test_labels_are_those_of_the_notice(labels, text):
    search = licenses.NoticeSearch(licenses.NOTICES)
    plain = " ".join(ALNUM_WORD.findall(text.translate(LOWER)))
    assert ",".join(sorted({search.notices[f[0]][1] for f in search.spans(plain)})) == labels


def test_licenses_of_an_empty_table(spark):
    assert licenses.scan(frame(spark, ["a"]).limit(0)).count() == 0


def test_clean_documents_get_no_label_of_the_method(docs):
    for r in licenses.scan(docs).join(docs.select("doc_id", "text"), "doc_id").filter("labels <> base_labels").collect():
        assert "rights reserved" in r["text"].lower() or "licen" in r["text"].lower() or "permission" in r["text"].lower()


# -- toxicity -------------------------------------------------------------------------------------


def brute_segments(x):
    """All maximal scoring segments, by the definition (recursion on the best segment)."""
    if not len(x) or max(x) <= 0:
        return []
    total = np.concatenate([[0.0], np.cumsum(x)])
    best = max(((total[j] - total[i], -(j - i), -i), i, j) for i in range(len(x)) for j in range(i + 1, len(x) + 1))
    _, i, j = best
    return [(a, b) for a, b in brute_segments(x[:i])] + [(i, j)] + [(a + j, b + j) for a, b in brute_segments(x[j:])]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.integers(-40, 60)), max_size=14))
def test_maximal_segments(items):
    drift = -3.0
    x = [g + 0.001 * k if scored and g else drift for k, (scored, g) in enumerate(items)]
    at = [k for k, (scored, g) in enumerate(items) if scored and g]
    got = toxicity.maximal_segments(at, [x[k] for k in at], drift)
    assert [(a, b) for a, b, _ in got] == brute_segments(x)
    for a, b, s in got:
        assert s == pytest.approx(sum(x[a:b]))


def toxic_frames(spark):
    rng = np.random.default_rng(2)
    texts, labels = [], []
    for k in range(400):
        w = [f"w{int(j)}" for j in rng.integers(0, 400, 80)]
        bad = k % 4 == 0
        if bad:
            for at in rng.integers(0, 80, 6):
                w[at] = ["scum", "moron", "trash"][at % 3]
        texts.append(" ".join(w))
        labels.append((k, int(bad)))
    return frame(spark, texts + ODD), spark.createDataFrame([*labels, (0, 1), (None, 1), (7, None)], "doc_id long, toxic int")


def test_a_sample_counts_ids_once(spark):
    rows = [(1, "a")] * 500 + [(k, "a") for k in range(2, 200)] + [(k, "b") for k in range(5)] * 3
    got = sample_by(spark.createDataFrame(rows, "doc_id long, g string").repartition(4), "g", 20).collect()
    assert len(got) == len(set(got)) == 25 and sum(r["g"] == "b" for r in got) == 5


def test_toxicity_learns_from_an_id_once(spark):
    df, labels = toxic_frames(spark)
    df = df.select("doc_id", "text")
    again = df.unionByName(df.filter("doc_id = 5").select("doc_id", F.concat("text", F.lit(" zz")).alias("text"))).unionByName(df.filter("doc_id < 9"))
    a, b = toxicity.train(df, labels), toxicity.train(again, labels)
    assert (a.keys == b.keys).all() and a.scores == pytest.approx(b.scores) and a.slopes == pytest.approx(b.slopes)


def test_toxicity_learns_and_takes_odd_rows(spark):
    df, labels = toxic_frames(spark)
    model = toxicity.train(df.select("doc_id", "text"), labels)
    rows = toxicity.score(df.withColumn("score", F.lit("old")), model, keep=("doc_id", "score")).collect()
    assert len(rows) == 400 + len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    for r in rows:
        if r["doc_id"] < 400 and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2:
            assert r["predicted"] == (r["doc_id"] % 4 == 0), r
        if r["doc_id"] >= 400:
            assert r["predicted"] == 0
    assert toxicity.score(df.limit(0), model).count() == 0


def test_toxicity_equals_a_plain_version(spark):
    """The model's words from plain counts, and every score from brute-force segments."""
    df, labels = toxic_frames(spark)
    model = toxicity.train(df.select("doc_id", "text"), labels)
    texts = {r["doc_id"]: ALNUM_WORD.findall((r["text"] or "").translate(LOWER)) for r in df.collect()}
    mark = {}
    for r in labels.collect():
        if r["doc_id"] is not None and r["toxic"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2:
            mark[r["doc_id"]] = max(mark.get(r["doc_id"], 0), r["toxic"])
    y, x = Counter(), Counter()
    for i, toxic in mark.items():
        (y if toxic else x).update(set(texts[i]))
    n_y, n_x, m = sum(y.values()), sum(x.values()), toxicity.PRIOR_MASS
    want = {}
    for w in set(y) | set(x):
        prior = (x[w] + y[w]) / (n_x + n_y) * m
        a, b = y[w] + prior, x[w] + prior
        odds = math.log(a / (n_y + m - a)) - math.log(b / (n_x + m - b))
        ratio = 2 * sum(c * math.log(c * (n_x + n_y) / ((x[w] + y[w]) * n)) for c, n in ((y[w], n_y), (x[w], n_x)) if c)
        if math.sqrt(max(0.0, ratio)) >= toxicity.Z_LEAST:
            want[textvec.hash_bytes(w.encode())] = odds
    assert dict(zip(model.keys.tolist(), model.scores.tolist(), strict=True)) == pytest.approx(want)
    share = {textvec.hash_bytes(w.encode()): x[w] / n_x for w in x}
    rest = 1 - sum(share.get(k, 0.0) for k in want)
    at = lambda lam: sum(share.get(k, 0.0) * math.exp(lam * s) for k, s in want.items()) + rest * math.exp(lam * model.drift)
    assert at(model.lam) == pytest.approx(1) or (at(model.lam) < 1 and model.lam >= 63)  # no root: clean texts lack the words
    for r in toxicity.score(df, model).collect():
        ws = texts[r["doc_id"]]
        if len(ws) > 200:
            continue
        scores = [want.get(textvec.hash_bytes(w.encode()), model.drift) for w in ws]
        found = [sum(scores[i:j]) for i, j in brute_segments(scores)]
        evidence = sum(max(0.0, model.lam * s - model.log_k - math.log(len(ws))) for s in found)
        features = (60 * (1 - math.exp(-evidence / 60)), math.log1p(100 * evidence / (len(ws) + 50)))
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-sum(a * b for a, b in zip(model.slopes, features, strict=True)) - model.level)))


def test_toxicity_without_labels(spark):
    df, labels = toxic_frames(spark)
    model = toxicity.train(df.select("doc_id", "text"), labels.limit(0))
    assert toxicity.score(df, model).agg(F.max("score")).first()[0] < 1e-6


def test_toxicity_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    rows = toxicity.query(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("held_out").select("toxic", "score").collect()
    good, bad = [r["score"] for r in rows if r["toxic"]], [r["score"] for r in rows if not r["toxic"]]
    assert np.mean([g > b for g in good for b in bad]) + 0.5 * np.mean([g == b for g in good for b in bad]) > 0.75


# -- language -------------------------------------------------------------------------------------


WORDS = ["the", "thing", "e", "straße", "qqzxj", "Достопримечательность", "донаудампфшифффартсгезельшафт", "日本語の文章はここで続きますそして終わります", "ภาษาไทยเขียนติดกันไปเรื่อยๆ", "x" * 90, "internationalisierungsbestrebungen" * 3]


def test_forward_pass_sums_all_segmentations():
    vocab = langid.vocabulary()
    assert max(map(len, vocab)) > 8
    s = langid.Segmenter(vocab)
    rng = np.random.default_rng(1)
    log_p = np.log(rng.random((len(vocab), 2)) * 1e-2)
    place = {v: k for k, v in enumerate(vocab)}
    longest = max(map(len, vocab))

    def total(w, k):
        """Log of the sum, by recursion over prefixes."""
        best = [0.0]
        for end in range(1, len(w) + 1):
            terms = [best[a] + log_p[place[w[a:end]], k] for a in range(max(0, end - longest), end) if w[a:end] in place]
            best.append(float(np.logaddexp.reduce(terms)))
        return best[-1]

    many = [w.encode() for w in WORDS]
    data, size = np.frombuffer(b"".join(many), np.uint8), np.array([len(w) for w in many])
    got = s.log_probability(data, np.cumsum(size) - size, size, log_p)
    np.testing.assert_allclose(got, [[total(w, 0), total(w, 1)] for w in many], rtol=1e-9)


def test_fit_counts_expected_uses():
    """One round of fitting, against every segmentation of short words."""
    vocab = [bytes([b]) for b in range(256)] + [b"ab", b"abc", b"bc"]
    s = langid.Segmenter(vocab)
    place = {v: k for k, v in enumerate(vocab)}

    def cuts(w):
        return [[]] if not w else [[w[:n], *rest] for n in range(1, len(w) + 1) if w[:n] in place for rest in cuts(w[n:])]

    p = 10.0 ** -(s.sizes + 1.0)
    uses = np.zeros(len(vocab))
    words_, weight = [b"abc", b"cab", b"bb"], np.array([2.0, 1.0, 3.0])
    for w, n in zip(words_, weight, strict=True):
        each = [(c, math.prod(p[place[x]] for x in c)) for c in cuts(w)]
        for c, q in each:
            for x in c:
                uses[place[x]] += n * q / sum(q for _, q in each)
    np.testing.assert_allclose(s.fit(words_, weight, rounds=1), (uses + 1e-3) / (uses.sum() + 1e-3 * len(uses)), rtol=1e-9)


def test_language_of_texts_without_spaces(spark):
    zh, th = "今天天气很好我们去公园散步", "วันนี้อากาศดีมากเราไปเดินเล่น"
    rows = [(k, (zh if k % 2 else th)[k % 5 :] * 3, "zh" if k % 2 else "th") for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for r in langid.predict(df, langid.train(df)).collect():
        assert r["lang_pred"] == ("zh" if r["doc_id"] % 2 else "th")


def test_language_scores_equal_a_plain_version(spark, docs):
    model = langid.train(docs)
    languages, p = model
    s, log_p = langid.Segmenter(langid.vocabulary()), np.log(model[1])
    few = docs.limit(25)
    got = {r["doc_id"]: r for r in langid.predict(few, model).collect()}
    for r in few.collect():
        runs = re.findall(r"[a-z\x80-\U0010ffff]+", (r["text"] or "").lower())
        if not runs:
            continue
        total = np.zeros(len(languages))
        for w in runs:
            b = np.frombuffer(w.encode(), np.uint8)
            total += s.log_probability(b, np.zeros(1, int), np.array([len(b)]), log_p)[0]
        odds = np.exp((total - total.max()) / math.sqrt(len(runs)))
        assert got[r["doc_id"]]["lang_pred"] == languages[int(total.argmax())] and got[r["doc_id"]]["score"] == pytest.approx(odds.max() / odds.sum())


def test_language_of_held_out_and_odd_rows(spark, docs):
    model = langid.train(docs)
    out = langid.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    assert out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.95
    odd = langid.predict(frame(spark, ODD, score="old"), model).orderBy("doc_id").collect()
    assert [r["lang_pred"] == "und" for r in odd] == [True, True, True, False, False, False, False, True, False]
    assert all(r["score"] == 0 for r in odd if r["lang_pred"] == "und") and all(0 <= r["score"] <= 1 for r in odd)
    assert langid.predict(docs.limit(0), model).count() == 0


def test_language_learns_from_an_id_once(spark, docs):
    docs = docs.select("doc_id", "text", "lang")
    few = docs.filter("doc_id < 60")
    nameless = few.withColumn("doc_id", F.lit(None).cast("long"))
    again = docs.unionByName(few).unionByName(few).unionByName(nameless).unionByName(few.withColumn("text", F.concat("text", F.lit(" zz"))))
    (a, p), (b, q) = langid.train(docs), langid.train(again)
    assert a == b and np.allclose(p, q)


def test_language_without_training_rows(spark):
    df = frame(spark, ["some words", None]).withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in langid.predict(df, langid.train(df)).collect()} == {"und"}


# -- language model -------------------------------------------------------------------------------


def lm(spark, df):
    model, counts = suffixlm.train(df.filter(suffixlm.remainder("doc_id", 7) != 2).select("text"))
    return model, suffixlm.score(df, model, counts)


def check_base(rows, texts):
    c = Counter()
    for i, t in texts.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            c.update([*words(t), "\0end"])
    n, v = sum(c.values()), len(c)
    for r in rows:
        w = [*words(texts[r["doc_id"]]), "\0end"]
        assert r["n_tokens"] == len(w) and r["n_known"] == sum(c[x] > 0 for x in w) and r["train_tokens"] == n
        assert r["base_score"] == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w))


class PlainTree:
    """The suffix tree by dictionaries: contexts grown level by level, the same tests and smoothing."""

    def __init__(self, texts, depth=suffixlm.DEPTH, least=suffixlm.LEAST_COUNT):
        c, grams = Counter(), [Counter() for _ in range(depth + 1)]
        for t in texts:
            seq = ["$", *words(t), "$"]
            c.update(seq[1:])
            for k in range(1, depth + 1):
                grams[k].update(tuple(seq[i - k : i + 1]) for i in range(k, len(seq)))
        self.c, self.n, self.depth = c, sum(c.values()), depth
        once, twice = sum(x == 1 for x in c.values()), sum(x == 2 for x in c.values())
        self.discount = once / (once + 2 * twice) if once and twice else 0.5
        self.listed = [{} for _ in range(depth + 1)]
        grams[0] = Counter({(w,): x for w, x in c.items()})
        for k in range(1, depth + 1):
            often = {}
            for g, x in grams[k].items():
                if x >= least:
                    often.setdefault(g[:-1], {})[g[-1]] = x
            for context, then in often.items():
                if k > 1 and context[1:] not in self.listed[k - 1]:
                    continue
                total = grams[k - 1][context]
                s = {w: self.p(context[1:], w) for w in then}
                p = {w: (x + suffixlm.BETA * s[w]) / (total + suffixlm.BETA) for w, x in then.items()}
                left_s = max(1 - sum(s.values()), 1e-9)
                rest = (max(total - sum(then.values()), 0) + suffixlm.BETA * left_s) / (total + suffixlm.BETA)
                kl = sum(p[w] * math.log(p[w] / s[w]) for w in p) + rest * math.log(rest / left_s)
                if total * kl > 0.5 * (len(then) + 1) * math.log(max(self.n, 2)):
                    self.listed[k][context] = (p, rest / left_s)

    def p(self, context, w):
        """By the longest retained suffix of the context."""
        x = self.c.get(w, 0)
        out = (x - self.discount if x else self.discount * len(self.c)) / self.n
        for k in range(1, self.depth + 1):
            state = self.listed[k].get(context[-k:]) if len(context) >= k else None
            if state is None:
                break
            out = state[0][w] if w in state[0] else out * state[1]
        return out

    def score(self, text):
        seq = ["$", *words(text), "$"]
        return sum(math.log10(self.p(tuple(seq[max(0, i - self.depth) : i]), seq[i])) for i in range(1, len(seq)))


def test_language_model(spark, docs):
    _, out = lm(spark, docs)
    rows = out.collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    check_base(rows, texts)
    plain = PlainTree([t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2])
    for r in rows:
        assert r["score"] == pytest.approx(plain.score(texts[r["doc_id"]]), rel=1e-9)
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def deep_texts():
    """What follows depends on three words back, and elsewhere on four."""
    rng = np.random.default_rng(6)
    out = []
    for k in range(400):
        a, b = ("red", "blue")[k % 2], ("one", "two")[k // 2 % 2]
        out.append(f"{a} x y {a}end f{int(rng.integers(0, 60))} {b} x y z {b}end k y m k y z n j z w " * 2 + f"tail{k}")
    return [*out, *ODD]


@pytest.mark.parametrize("sent", [suffixlm.SENT_FACTORS, 0, 30])
def test_contexts_of_three_and_four_words(spark, monkeypatch, sent):
    """Retained where they tell, and scores those of a plain tree, however many factors are sent."""
    monkeypatch.setattr(suffixlm, "SENT_FACTORS", sent)
    texts = deep_texts()
    model, out = lm(spark, frame(spark, texts, score="old"))
    plain = PlainTree([t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 7 != 2])
    assert ("red", "x", "y") in plain.listed[3] and ("one", "x", "y", "z") in plain.listed[4] and model.depth == 4
    rows = out.collect()
    check_base(rows, dict(enumerate(texts)))
    for r in rows:
        assert r["score"] == pytest.approx(plain.score(texts[r["doc_id"]]), rel=1e-9)


def test_language_model_over_many_partitions(spark):
    """n-grams that meet only across partitions, and copies in each of them: counts and parts are those of all texts."""
    texts = [t for k in range(24) for t in ("p q r s t", f"p q r u{k} x{k}", f"q r s{k}")]
    df = frame(spark, texts).repartition(12, "doc_id")
    _, out = lm(spark, df)
    rows = out.collect()
    check_base(rows, dict(enumerate(texts)))
    plain = PlainTree([t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 7 != 2])
    assert plain.listed[1]
    for r in rows:
        assert r["score"] == pytest.approx(plain.score(texts[r["doc_id"]]), rel=1e-9)


def test_language_model_hashes_words_by_blocks(monkeypatch):
    """Each of the seven passes hashes all words again: no word of usual length takes the slow way."""
    monkeypatch.setattr(textvec.Words, "hash_of", lambda *_: pytest.fail("words are hashed one byte at a time"))
    batch = pa.RecordBatch.from_arrays([pa.array(range(3)), pa.array(["Two words two", None, "x" * 300])], names=["doc_id", "text"])
    sieve = np.full(4096, 255, np.uint8)
    counts = pa.Table.from_batches(suffixlm._count_words([batch])).to_pydict()
    assert sorted(counts["n"]) == [1, 1, 2, 3]
    grams = pa.Table.from_batches(suffixlm._count_grams(1, sieve)([batch])).to_pydict()
    parts = pa.Table.from_batches(suffixlm._find_parts([(sieve, sieve)])([batch])).to_pydict()
    assert grams["n"] == [1] * 7 and sorted(grams["key"]) == sorted(parts["key"]) and len(set(grams["key"])) == 7
    scored = pa.Table.from_batches(suffixlm._scorer(suffixlm.Model())([batch])).to_pydict()
    assert scored["n_tokens"] == [4, 1, 2]


def test_states_are_distributions():
    plain = PlainTree(deep_texts())
    unseen = plain.discount * len(plain.c) / plain.n
    for k in range(1, 5):
        for context in list(plain.listed[k])[:40]:
            mass = sum(plain.p(context, w) for w in plain.c)
            rest = plain.p(context, "never seen")
            assert mass + rest == pytest.approx(1, abs=1e-6) or rest < unseen


def test_frequent_grams_whatever_the_size(spark):
    """A context seen often enough is a state, however many tokens surround it."""
    often = "red fox jumps " * 17
    noise = spark.range(200).select((F.col("id") + 1000).alias("doc_id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(10_000)), lambda k: F.concat(F.lit("w"), (F.col("id") * 10_000 + k).cast("string")))).alias("text"))
    few = spark.createDataFrame([(0, often)], "doc_id long, text string")
    model, counts = suffixlm.train(few.unionByName(noise).select("text"))
    assert model.tokens > 2_000_000 and model.depth >= 1
    row = suffixlm.score(few, model, counts).first()
    assert row["score"] / row["n_tokens"] > -1


def test_language_model_without_training_and_without_rows(spark):
    df = frame(spark, ["a b"]).limit(0)
    model, counts = suffixlm.train(df.select("text"))
    row = suffixlm.score(frame(spark, ["a b"]), model, counts).first()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"], row["base_score"]) == (3, 0, 0, 0.0)
    assert suffixlm.score(df, model, counts).count() == 0


# -- mixing ---------------------------------------------------------------------------------------


def water(sizes, weights):
    """Targets by filling in rounds."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    budget, out, free = float(sum(sizes.values())), {}, [s for s in names if sizes[s]]
    while free:
        level = budget / sum(w[s] for s in free)
        over = [s for s in free if level * w[s] > 3 * sizes[s]]
        if not over:
            out |= {s: level * w[s] for s in free}
            break
        for s in over:
            out[s] = 3.0 * sizes[s]
            budget -= out[s]
            free.remove(s)
    return {s: out.get(s, 0.0) for s in names}


def test_targets(spark):
    sizes = {"a": 10, "b": 500, None: 700, "c": 3, "d": 900, "e": 0, "é": 40}
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    assert got == pytest.approx(water(sizes, (5, 2, 1)))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 1), st.integers(1, 1000)), max_size=40))
def test_flight_keeps_its_sums(items):
    p, size = np.array([x for x, _ in items]), np.array([float(n) for _, n in items])
    if not len(p):
        return
    balance = np.stack([size / size.max(), np.ones(len(size))])
    q = mixing.flight(p, balance)
    assert ((q > 1e-9) & (q < 1 - 1e-9)).sum() <= 2
    np.testing.assert_allclose(balance @ q, balance @ p, atol=1e-5 * len(p))


def test_mixing_of_many_equal_rows(spark):
    """Equal rows are units like others: many of them, some taken once more than the rest; no rows at all."""
    rows = [(1, "same text", "a")] * 5000 + [(k, "w " * (k % 40 + 1), "b") for k in range(2, 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    for doc in ("a", "b"):
        mine = [r for r in got if (r["doc_id"] == 1) == (doc == "a")]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 41
    copies = {r["copies"] for r in got if r["doc_id"] == 1}
    assert len(copies) == 2 and max(copies) - min(copies) == 1
    assert mixing.mix(df.limit(0)).count() == 0


def test_mixing(spark):
    rng = np.random.default_rng(3)
    rows = [(k, " ".join(["w"] * int(rng.integers(1, 120))), "s0" if k % 3 else f"s{k % 7}", k) for k in range(3000)]
    rows += [(9000 + k, t, None, 0) for k, t in enumerate(ODD)] + [(1, "same text here", "s1", 5)] * 7
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, target long")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    again = mixing.mix(df.repartition(5)).collect()
    order = lambda out: sorted((r["doc_id"], r["size"], r["taken"]) for r in out)
    assert order(got) == order(again)
    sizes = {}
    for i, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    want = water(sizes, (5, 2, 1))
    by = {}
    source = {}
    for i, t, s, _ in rows:
        source.setdefault((i, len(WORD.findall(t or ""))), s)
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by[source[(r["doc_id"], r["size"])]] = by.get(source[(r["doc_id"], r["size"])], 0) + r["taken"]
    longest = {}
    for i, t, s, _ in rows:
        longest[s] = max(longest.get(s, 0), len(WORD.findall(t or "")))
    for s in want:  # within one document: what can't be split
        assert abs(by[s] - want[s]) <= longest[s]
    out = mixing.mixed(df)
    assert out.columns == df.columns
    assert out.agg(F.sum(mixing.size_of(F.col("text")))).first()[0] == sum(r["taken"] for r in got)
    assert mixing.mixed(df.limit(0)).count() == 0


def test_mixed_rows_of_one_key_agree_in_reruns(spark):
    rows = [(1, "same text here", "s", k % 5, {"k": k % 3}) for k in range(40)] + [(k, "w " * k, "t", 0, None) for k in range(2, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, other int, more map<string,int>")
    order = lambda out: sorted((r["doc_id"], r["other"], str(r["more"])) for r in out.collect())
    assert order(mixing.mixed(df)) == order(mixing.mixed(df.repartition(7)))
