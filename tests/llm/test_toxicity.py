"""Operator 10 learns from every labelled row."""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from canopy import storage
from canopy.llm import toxicity

DOCS, MARKS = "doc_id long, text string, lang string", "doc_id long, toxic int"
QUICK = toxicity.ToxicityConfig(steps=50, rounds=2)


def score(model, *texts):
    return toxicity.score_column(pa.array(texts), model, toxicity._tables(model))


def learned(model, word):
    whole, _, _ = next(toxicity.word_features(pa.array([word]), model.config))
    return bool(model.embedding[0, whole[0]].any())


def test_fit_reaches_rows_beyond_any_sample(spark):
    """Only the last 60 of 2,100 toxic rows in the order of a hash hold `zorv`: a sample of 2,000 missed it."""
    rng = np.random.RandomState(1)
    rank = {r.id: i for i, r in enumerate(spark.range(2100).orderBy(F.xxhash64("id", F.lit(5)), "id").collect())}
    clean = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(200)]
    rows = [(i, " ".join([*rng.choice(clean, 3), "scum" if rank.get(i, 0) < 2040 else "zorv"][: 4 if i < 2100 else 3]), "en") for i in range(2600)]
    # In one shard, and in several.
    for c in (toxicity.ToxicityConfig(steps=300), toxicity.ToxicityConfig(steps=300, shard_bytes=20_000)):
        model = toxicity.fit(spark.createDataFrame(rows, DOCS), spark.createDataFrame([(i, int(i < 2100)) for i in range(2600)], MARKS), c)
        assert score(model, "waa wbb zorv", "waa wbb scum").min() >= 0.5
        assert score(model, "waa wbb wcc")[0] < 0.3


def test_fit_reads_long_texts_whole(spark):
    """Texts of more than 20,000 words teach, to their last word; a window may cross the chunks they are read in."""
    rows = [(i, "x y " * 10_001 + "lastword" if i < 3 else "fine words here", "en") for i in range(12)]
    model = toxicity.fit(spark.createDataFrame(rows, DOCS), spark.createDataFrame([(i, int(i < 3)) for i in range(12)], MARKS), toxicity.ToxicityConfig(steps=4, rounds=1))
    assert learned(model, "lastword") and learned(model, "fine") and not learned(model, "unseen")


def test_chunks_do_not_change_maxima(monkeypatch):
    rng = np.random.RandomState(3)
    c = toxicity.ToxicityConfig(buckets=64)
    begin = np.cumsum([0, 5, 0, 1, 90, 2, 40])
    a, b = rng.randint(0, 64, (2, begin[-1]))
    embedding, kernels = rng.normal(size=(2, 64, c.dim)).astype(np.float32), [rng.normal(size=(w, 2 * c.dim, c.filters)).astype(np.float32) for w in c.widths]
    want = toxicity._maxima(a, b, begin, embedding, kernels, c)
    monkeypatch.setattr(toxicity, "CHUNK_WORDS", 7)
    got = toxicity._maxima(a, b, begin, embedding, kernels, c)
    np.testing.assert_allclose(got[0], want[0], rtol=1e-5)
    np.testing.assert_array_equal(got[1], want[1])


def test_every_language_gets_a_threshold(spark):
    """A fifth of the rows missed most of twelve languages of one row each."""
    rows = [(i, f"some words {'trash' if i % 3 == 0 else 'here'}", f"l{i}") for i in range(12)]
    model = toxicity.fit(spark.createDataFrame(rows, DOCS), spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(12)], MARKS), QUICK)
    assert set(model.thresholds) == {f"l{i}" for i in range(12)}


def test_calibrate_counts_every_row():
    bins, n, toxic = np.array([100, 9000, 4000]), np.array([900, 50, 50]), np.array([0, 50, 0])
    assert toxicity.calibrate(bins, n, toxic) == (5000 + 9000) / 2 / toxicity.BINS


def test_shards_do_not_depend_on_partitions(spark):
    rows = [(i, f"w{chr(97 + i % 7)} w{chr(97 + i % 11)} {'trash' if i % 4 == 0 else 'fine'}", "en") for i in range(300)]
    marks = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)], MARKS)
    c = toxicity.ToxicityConfig(steps=50, rounds=2, shard_bytes=1000)
    one, other = (toxicity.fit(spark.createDataFrame(rows, DOCS).repartition(n), marks, c) for n in (1, 5))
    assert np.array_equal(one.embedding, other.embedding) and one.thresholds == other.thresholds


def test_fit_shuffles_no_text_and_only_labelled_words(spark, monkeypatch):
    """Texts were shuffled to their labels, those without a label too; and what was hashed stayed on disk through the rounds."""
    seen = []
    dealt, one_round = toxicity._dealt, toxicity._round

    def spy(hashed, marks, c):
        seen.append((hashed.columns, hashed.count()))
        return dealt(hashed, marks, c)

    def spy_round(rows, *rest):
        seen.append(sorted(p.name.split("-")[0] for p in Path(storage.shared_folder(spark).removeprefix("file:")).iterdir() if p.name.startswith("toxic_")))
        return one_round(rows, *rest)

    monkeypatch.setattr(toxicity, "_dealt", spy)
    monkeypatch.setattr(toxicity, "_round", spy_round)
    rows = [(i, f"some words w{i}", "en") for i in range(4000)]
    toxicity.fit(spark.createDataFrame(rows, DOCS), spark.createDataFrame([(40 * i, i % 2) for i in range(100)], MARKS), toxicity.ToxicityConfig(steps=2, rounds=1))
    (columns, n), folders = seen
    assert "text" not in columns and 100 <= n < 1000
    assert "toxic_shards" in folders and "toxic_rows" not in folders


def test_a_full_sieve_changes_nothing(spark):
    """Where every bit is set all documents pass, and those without a label are dropped when they meet the labels."""
    rows = spark.createDataFrame([(i, f"w{chr(97 + i % 7)} {'trash' if i % 4 == 0 else 'fine'}", "en") for i in range(300)], DOCS)
    marks = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(0, 300, 2)], MARKS)
    one, other = (toxicity.fit(rows, marks, toxicity.ToxicityConfig(steps=20, rounds=1, sieve_bits=bits)) for bits in (64, 1 << 27))
    assert np.array_equal(one.embedding, other.embedding) and one.thresholds == other.thresholds
