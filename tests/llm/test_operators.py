"""The operators against brute force, reference libraries and planted cases, with nulls, empty and long texts, ties and odd columns."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from canopy.llm import ann, bpe, components, counts, jaccard, language, linededup, media, mixing, pretoken, queries, sharding, toxicity

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TEXTS = [None, "", " ", "\n\n", "don't WE'LL 's ''s x''re", "a" * 5000 + "'ll" + "!" * 300, "tab\tand  two  spaces　wide été 12٣ \U0001f600", "trail \n ", "x y z"]


@pytest.fixture(scope="module")
def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def docs(spark, texts, schema="doc_id long, text string"):
    return spark.createDataFrame(list(enumerate(texts)), schema)


def test_pieces_match_the_pattern():
    import regex

    pattern, rng = regex.compile(public_tokenizers.PATTERN), random.Random(1)
    letters = list("'''strevlmdaS  \n\t1!") + ["٣", "é", "　", "\x85", "\x1c", "²", "́"]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 14))) for _ in range(5000)]
    found, first = pretoken.pieces(texts)
    for i, t in enumerate(texts):
        assert found[first[i] : first[i + 1]] == [m.group() for m in pattern.finditer(t)]


def test_encoding_matches_the_library_and_decodes(spark, encoding):
    df = docs(spark, TEXTS).withColumn("ids", F.lit("clash"))
    got = {r.doc_id: r for r in queries.token_digests(df, RANKS).collect()}
    for i, t in enumerate(TEXTS):
        ids = encoding.encode_ordinary(t or "")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    encoded = bpe.encode_documents(df, RANKS)
    for r in encoded.collect():
        raw = (TEXTS[r.doc_id] or "").encode()
        assert all(raw[o:].startswith(encoding.decode_single_token_bytes(t)) for o, t in zip(r.offsets, r.ids, strict=True))
    assert {r.doc_id: r.text for r in bpe.decode_documents(encoded, RANKS).collect()} == {i: t or "" for i, t in enumerate(TEXTS)}
    assert queries.token_digests(df.limit(0), RANKS).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 7, 100])
def test_shards_have_even_counts_and_no_gaps(spark, n):
    df = spark.range(n).select(F.when(F.col("id") % 10 != 3, F.col("id") % 40).alias("k"), F.lit(1).alias("shard"))
    out = sharding.shard_rows(df, ["k"], 8, 17).toPandas()
    assert len(out) == n
    sizes = [len(g) for _, g in out.groupby("shard")]
    assert not sizes or n < 8 or max(sizes) - min(sizes) <= 1
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in out.groupby("shard"))


def test_permutation_inverts_and_does_not_depend_on_partitions(spark):
    for n in (1, 5, 33, 1000):
        got = spark.range(n).select("id", sharding.permute(F.col("id"), n, 3).alias("p")).withColumn("back", sharding.permute(F.col("p"), n, 3, True)).toPandas()
        assert sorted(got.p) == list(range(n)) and (got.back == got.id).all()
    df = spark.range(50).withColumnRenamed("id", "k")
    a, b = (sorted(map(tuple, sharding.shard_rows(df.repartition(p), ["k"], 4, 1).collect())) for p in (1, 7))
    assert a == b


def test_media_round_trip_and_features(spark):
    out = {r.doc_id: r for r in media.media_digests(media.store_media(docs(spark, [*TEXTS, "b" * 64, "abc" * 9000, "abc" * 9000]))).collect()}
    for i, t in enumerate([*TEXTS, "b" * 64, "abc" * 9000]):
        raw = (t or "").encode()
        want = raw + bytes(64 if not raw else -len(raw) % 64)
        assert (out[i].n_bytes, out[i].payload_bytes, out[i].payload_sha256, out[i].tail_crc32) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-64:]))
    assert out[len(TEXTS) + 1].feature == out[len(TEXTS) + 2].feature
    c = media.AudioConfig()
    quiet, loud = np.full(4000, 128, np.uint8), (128 + 100 * np.sin(np.arange(4000))).astype(np.uint8)
    f = media.features(np.concatenate([quiet, loud, quiet]).tobytes(), c)
    assert len(f.spans) == 1 and 0.4 < f.times[0, 0] < 0.6 and 0.9 < f.times[0, 1] < 1.1
    assert f.as_tensor_array().type.shape == [c.shape, c.bands]
    rows = media.audio_features(media.store_media(docs(spark, ["abc" * 9000, None]))).collect()
    assert all(len(r.tensor) == c.shape * c.bands for r in rows)


def near(rows, num=75):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= num * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return sorted(((rows[i][0], len(sets[i]), least[find(i)]) for i in range(len(rows))), key=str)


def test_near_duplicates_lose_no_link(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(4000)]
    passage, base = rng.choices(vocabulary, k=60), rng.choices(vocabulary, k=200)
    texts = []
    for _ in range(120):
        t = list(base)
        for _ in range(rng.randint(0, 9)):
            t[rng.randrange(200)] = rng.choice(vocabulary)
        texts.append(t)
    texts += [passage + rng.choices(vocabulary, k=rng.randint(0, 40)) for _ in range(60)]
    texts += [rng.choices(vocabulary, k=rng.randint(1, 400)) for _ in range(40)] + [[], ["a"], ["A"], ["a", "b", "c"]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(900, None), (0, " ".join(texts[0])), (None, "x y z"), (None, "p q r s t u")]
    df, want = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit(1)), near(rows)
    tight = jaccard.JaccardConfig(frequent=4, salt_rows=16, block_bytes=4096, verify_block=4, leaf=4, broadcast_ids=0, single_weight=2, pivot_rounds=1)
    for c in (jaccard.JaccardConfig(), tight):
        assert sorted(map(tuple, jaccard.near_duplicates(df, c).collect()), key=str) == want
    assert jaccard.near_duplicates(df.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i + 1, i) for i in range(30)] + [(100, 100 + i) for i in range(1, 20)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(31)} == {0} and {got[i] for i in range(100, 120)} == {100}


def test_search_recall_ties_and_odd_vectors(spark):
    rng = np.random.RandomState(0)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[700:1000] = x[700]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2100, [0.0] * 16), (2200, [float("nan")] * 16), (2300, [None] + [1.0] * 15), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.search(df, F.col("vec_id") % 100 == 0).toPandas()
    assert set(got.query_id) == set(range(0, 1500, 100))
    hits = 0
    for q, g in got.groupby("query_id"):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        want = [i for i in np.lexsort((np.arange(1500), d)) if i != q][:10]
        g = g.sort_values("rank")
        assert g["rank"].tolist() == list(range(1, 11)) and np.allclose(g["score"], d[g.vec_id], atol=1e-12)
        hits += len(set(want) & set(g.vec_id))
        if 700 <= q < 1000:
            assert g.vec_id.tolist() == want
    assert hits / 150 >= 0.9
    few = ann.search(df.filter("vec_id < 4"), F.col("vec_id") == 0).toPandas()
    assert sorted(few.vec_id) == [1, 2, 3]
    assert ann.search(df.limit(0), F.lit(True)).count() == 0


def test_search_recall_without_clusters(spark):
    x = np.random.RandomState(1).normal(size=(6000, 64))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    # Small units and parts, and a bound from few vectors, as on large tables.
    for c in ({}, {"block_rows": 64, "query_rows": 16, "bound_rows": 200}):
        got, hits = ann.search(df, F.col("vec_id") % 100 == 0, ann.SearchConfig(**c)).toPandas(), 0
        for q, g in got.groupby("query_id"):
            d = ((x.astype(float) - x[q].astype(float)) ** 2).sum(1)
            d[q] = np.inf
            hits += len(set(np.argsort(d)[:10]) & set(g.vec_id))
        assert hits >= 0.99 * 600


def test_mixing_fills_to_targets(spark):
    rng = random.Random(2)
    rows = [(i, "a" if i % 3 else rng.choice(["b", "c", None]), rng.randint(0, 50)) for i in range(600)] + [(700, "d", 0), (None, "b", 5)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long").withColumn("mix_key", F.lit(0))
    draw = mixing.draw_key(1, F.col("doc_id"))
    plan = mixing.plan_mix(df.select("source", "size", draw.alias("draw")), (5.0, 2.0, 1.0), 1.5, 2)
    out = mixing.apply_mix(df, plan, F.col("source"), F.col("size"), draw).toPandas()
    out["taken"] = out["size"] * out.mix_copies + out.mix_part
    assert len(out) == 602 and (out.taken <= 2 * out["size"]).all()
    for _, g in out.groupby("source", dropna=False):
        assert abs(g.taken.sum() - g.mix_target.iloc[0]) <= 1
        assert g.mix_target.iloc[0] <= 2 * g["size"].sum() + 1e-9
    per = out.groupby("source", dropna=False).mix_target.first().sum()
    assert per == pytest.approx(1.5 * out["size"].sum())


def test_token_histogram_answers_limits(spark):
    lengths = [0, 0, 3, 3, 3, 10, 2500, 7]
    h = counts.length_histogram(spark.createDataFrame([(x,) for x in lengths], "n_tokens long"))
    for limit in (0, 1, 3, 5, 10, 100, 9999):
        assert counts.truncated_total(h, limit) == sum(min(x, limit) for x in lengths)
    assert [counts.length_quantile(h, q) for q in (0.25, 0.5, 1.0)] == [0, 3, 2500]
    assert counts.length_histogram(spark.createDataFrame([], "n_tokens long")).count() == 0
    assert sorted(r.n_tokens for r in counts.token_lengths(docs(spark, [None, "", "a b"]), RANKS).collect()) == [0, 0, 2]


def deleted(rows, least):
    """Lines to delete by the definition: those in a run of enough words that occurs earlier."""
    flat = [(d, t.split("\n")) for d, t in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[0] is not None, r[0] or 0))]
    places, gone = {}, {}
    for d, lines in flat:
        for s in range(len(lines)):
            for e in range(s + 1, len(lines) + 1):
                places.setdefault(tuple(lines[s:e]), (d, s))
    for d, lines in flat:
        for s in range(len(lines)):
            for e in range(s + 1, len(lines) + 1):
                run = tuple(lines[s:e])
                if sum(max(1, len(x.split())) for x in run) >= least and places[run] != (d, s):
                    gone.setdefault(d, set()).update(range(s, e))
    return {d: "\n".join(x for i, x in enumerate(lines) if i not in gone.get(d, ())) for d, lines in flat}


def test_line_runs_are_deleted_where_they_recur(spark):
    rng = random.Random(3)
    pool = [" ".join(rng.choices("abcdefgh", k=rng.randint(0, 6))) for _ in range(12)]
    rows = [(i, "\n".join(rng.choices(pool, k=rng.randint(0, 14)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, rows[5][1]), (None, rows[7][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"_d": F.lit(1), "n_lines": F.lit(2)})
    for least in (4, 10):
        got = {r.doc_id: r.text for r in linededup.delete_repeated_runs(df, least).collect()}
        want = deleted(rows, least)
        assert got.pop(100) is None
        assert got == want
    assert linededup.delete_repeated_runs(df.limit(0)).count() == 0


def test_language_is_found_and_strange_text_rejected(spark):
    rng = random.Random(5)
    words_of = {"en": ["the", "and", "house", "with", "water"], "de": ["und", "der", "haus", "mit", "wasser"], "fr": ["le", "et", "maison", "avec", "eau"]}
    rows = [(i, " ".join(rng.choices(words_of[lang], k=rng.randint(5, 40))), lang) for i, lang in enumerate(["en", "de", "fr"] * 60)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    test = docs(spark, ["the house and the water", "der wasser und mit", "le maison avec eau", None, "", "123 ?!", "אבג דהו זחט"])
    got = {r.doc_id: r for r in language.identify(test, model).collect()}
    assert [got[i].lang_pred for i in range(6)] == ["en", "de", "fr", "und", "und", "und"]
    assert [got[i].lang_rejected for i in range(7)] == [False] * 3 + [True] * 4
    assert all(0 <= r.lang_score <= 1 for r in got.values())
    empty = language.fit(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert {r.lang_pred for r in language.identify(test, empty).collect()} == {"und"}


def test_clean_words_are_kept_however_short():
    texts = ["erö avec maison und haus wasser the house with water " * 3, "le chat est avec nous dans la maison et il dort"]
    grams = np.stack([language.ngram_counts(t, language.LanguageConfig()) for t in texts])
    idf = np.ones(grams.shape[1], np.float32)
    centroids = np.stack([language.vector(g, idf) for g in grams]).astype(np.float32)
    # Radii that the cosine of a word reaches in part only.
    short = ["avec", "Avec.", "dort", "erö"]
    alone = [float((centroids @ language.vector(language.ngram_counts(t, language.LanguageConfig()), idf)).max()) for t in short]
    model = language.LanguageModel(language.LanguageConfig(), idf, centroids, np.array([0, 1]), ["a", "b"], np.full(2, 1.5 * max(alone)))
    assert language.predict_batch(short, model)[2] == [False] * len(short)
    assert language.predict_batch(["אבג", "привет мир", "漢字", "12 ?"], model)[2] == [True] * 4


def test_toxicity_learns_words_and_scores_any_text(spark):
    rng = random.Random(6)
    clean = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    rows, marks = [], []
    for i in range(400):
        t = rng.choices(clean, k=rng.randint(5, 60))
        if i % 4 == 0:
            t[rng.randrange(len(t))] = rng.choice(["Scum,", "idiot", "trash."])
        rows.append((i, " ".join(t), "en" if i % 2 else None))
        marks.append((i, int(i % 4 == 0)))
    d, m = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame([*marks, (3, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(d, m.filter("doc_id >= 100 or doc_id is null"))
    scored = {r.doc_id: r.toxic_score for r in toxicity.score(d, model).collect()}
    assert np.mean([scored[i] >= 0.3 for i in range(0, 100, 4)]) > 0.9
    assert np.mean([scored[i] >= 0.3 for i in range(100) if i % 4]) < 0.05
    assert set(model.thresholds) == {"en"}
    odd = toxicity.score(docs(spark, [None, "", "?", "idiot", "x " * 50000]), model).collect()
    assert all(0 <= r.toxic_score <= 1 for r in odd)
    none = toxicity.fit(d.limit(0), m.limit(0))
    assert toxicity.score_column(pa.array(["a b", None]), none, toxicity._tables(none)).tolist() == pytest.approx([0.01, 0.01], abs=0.05)


def test_pipeline_keeps_clean_documents(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    clean = [" ".join(rng.choices([f"{a}{b}n" for a in "bcdfg" for b in "aeiou"], k=60)) for _ in range(30)]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate([*clean, clean[0], None])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    d = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:3]:
        d = stage(spark, d, str(tmp_path))
        assert d.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    assert sorted(r.doc_id for r in d.collect()) == list(range(30))
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} <= set(range(30))


def test_pipeline_keeps_one_row_of_each_component(spark):
    import corpus_pipeline

    rng = random.Random(12)
    a, b, c, d = (" ".join(rng.choices([f"{x}{y}n" for x in "bcdfg" for y in "aeiou"], k=60)) for _ in range(4))
    rows = [(1, a), (1, a), (2, b), (3, b), (3, c), (None, d), (None, d), (None, a), (5, a)]
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, a), (2, b), (3, c), (None, d)], key=str)


def test_pipeline_mixes_whole_documents(spark):
    import corpus_pipeline

    rng = random.Random(13)
    rows = [(None if i % 2 else i % 5, " ".join(rng.choices("abcdefgh", k=rng.randint(3, 40))), f"s{i % 3}") for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [tuple(r) for r in corpus_pipeline.mix_sources(spark, df, "").collect()]
    assert set(got) <= set(rows)
    sizes = {s: sum(len(t.split()) for _, t, x in rows if x == s) for s in ("s0", "s1", "s2")}
    plan = mixing.plan_mix(df.select("source", F.regexp_count("text", F.lit(r"\S+")).cast("long").alias("size"), mixing.draw_key(1, F.col("text")).alias("draw")), queries.WEIGHTS, queries.SHARE, queries.EPOCHS)
    for r in plan.collect():
        taken = sum(len(t.split()) for _, t, x in got if x == r.source)
        assert r.source_size == sizes[r.source] and abs(taken - r.target) <= 21
