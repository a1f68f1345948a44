"""The pipeline against its stages done plainly."""

from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_text_operators import brute_components
from tidewatch.llm import bpe, langid, neardup, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def plain_targets(have):
    """Weights 5, 2, 1 by name share all sizes; a source stops at 3 times its own, the excess is shared again."""
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(have, key=lambda s: (s is None, s or "")))}
    full, open_ = {}, dict(have)
    while True:
        rest = sum(have.values()) - sum(full.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * have[s]]
        if not over:
            return full | share
        for s in over:
            full[s] = 3 * have[s]
            del open_[s]


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "near-duplicates", "mixing", "encoding"]
    kept = corpus_pipeline.drop_toxic(spark, docs, sf).cache()
    assert kept.columns == COLUMNS
    model = toxicity.train(docs.select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet"))
    bad = {r["doc_id"] for r in toxicity.score(docs, model).filter("predicted = 1").collect()}
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in docs.collect()} - bad

    known = corpus_pipeline.keep_known_languages(spark, kept, sf).cache()
    assert known.columns == COLUMNS and known.count() >= 0.98 * kept.count()
    away = kept.join(known, "doc_id", "left_anti").select("doc_id", "text")
    assert {r["lang_pred"] for r in langid.predict(away, langid.train(kept)).collect()} <= {"und"}
    junk = kept.limit(1).select(F.lit(-1).cast("long").alias("doc_id"), F.lit("1234 ... 5678 !!").alias("text"), "lang", "source", "n_chars")
    assert corpus_pipeline.keep_known_languages(spark, kept.unionByName(junk), sf).filter("doc_id = -1").count() == 0

    single = corpus_pipeline.drop_near_duplicates(spark, known, sf).cache()
    assert single.columns == COLUMNS
    # All pairs by their sets of shingles; nothing links without words.
    group = brute_components([(r["doc_id"], r["text"] or "") for r in known.collect()], neardup.THRESHOLD)
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(set(group.values())) and len(set(group.values())) < len(group)

    mixed = corpus_pipeline.mix_sources(spark, single, sf).cache()
    assert mixed.columns == COLUMNS
    count = {r["doc_id"]: r["n"] for r in mixed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = {r["doc_id"]: (r["source"], len((r["text"] or "").split())) for r in single.collect()}
    have, taken = {}, {}
    for i, (source, words) in rows.items():
        have[source] = have.get(source, 0) + words
        taken[source] = taken.get(source, 0) + words * count.get(i, 0)
    target = plain_targets(have)
    longest = max(words for _, words in rows.values())
    assert all(abs(taken[s] - target[s]) <= 2 * longest for s in have) and max(count.values()) <= 3

    lib = Tokenizer.from_file(bpe.tokenizer_path())
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    out = corpus_pipeline.encode(spark, mixed, sf).collect()
    assert len(out) == mixed.count()
    for r in out[:100]:
        assert r["ids"] == lib.encode(texts[r["doc_id"]], add_special_tokens=False).ids


def test_run_equals_its_stages(spark, sf):
    """run() against the stages called one after another, over tables dealt otherwise than run() writes them."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs.repartition(7), sf).cache()
    shape = lambda df: sorted(tuple(r) for r in df.select("doc_id", "n_tokens").collect())
    assert shape(docs) == shape(corpus_pipeline.run(spark, sf)) and docs.count()


def test_odd_rows(spark, sf):
    rows = [(1, None, None, None, None), (1, None, None, None, None), (None, "the thing and the other", "en", None, 3), (2, "", "en", "s", 0), (3, "the " * 20_000, "en", "s", 5), (4, "the only thing that", "en", "s", 5), (4, "the only thing that", "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("score", F.lit(1)).withColumn("kept", F.lit("x"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == [*COLUMNS, "score", "kept"]
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert out and {r["doc_id"] for r in out} <= {None, 3, 4}


def test_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf).cache()
        assert docs.count() == 0
