"""The registered queries over small tables against brute force, and the operators on hot keys, odd columns and empty tables."""

import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from canopy.llm import ann, bpe, common, jaccard, language, linededup, media, mixing, queries, toxicity

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def small(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_op1_and_op7_match_the_library(spark, small, encoding):
    ids = {d: encoding.encode_ordinary(t or "") for d, t, _, _ in small}
    for r in queries.op1_bpe(spark, SMALL).collect():
        text = next(t for d, t, _, _ in small if d == r.doc_id) or ""
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids[r.doc_id]), hashlib.sha256(" ".join(map(str, ids[r.doc_id])).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    lengths = [len(x) for x in ids.values()]
    rows = queries.op7_token_counts(spark, SMALL).collect()
    assert {r.n_tokens: r.n_docs for r in rows} == Counter(lengths)
    for r in rows:
        at_least = [n for n in lengths if n >= r.n_tokens]
        assert (r.docs_at_least, r.tokens_at_least, r.total_tokens, r.truncated_tokens) == (len(at_least), sum(at_least), sum(lengths), sum(min(n, r.n_tokens) for n in lengths))
        assert r.share_at_most == pytest.approx(sum(n <= r.n_tokens for n in lengths) / len(lengths))


def test_op2_laws(spark, small):
    rows = queries.op2_sharding(spark, SMALL).collect()
    texts = {d: (t or "").encode() for d, t, _, _ in small}
    assert all((r["size"], r.text_crc32, r.law, r.grown_shard) == (len(texts[r.doc_id]) + 1, zlib.crc32(texts[r.doc_id]), "rows", None) for r in rows)
    of = Counter(r.shard for r in rows)
    assert set(of) == set(range(8)) and max(of.values()) - min(of.values()) <= 1
    assert all(sorted(r.slot for r in rows if r.shard == k) == list(range(n)) for k, n in of.items())


def test_op3_payloads(spark, small):
    texts = {d: (t or "").encode() for d, t, _, _ in small}
    for r in queries.op3_audio(spark, SMALL).collect():
        want = texts[r.doc_id] + bytes(-len(texts[r.doc_id]) % 64 if texts[r.doc_id] else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(texts[r.doc_id]), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-64:]))
        f = media.features(want, media.AudioConfig())
        assert f"frames={len(f.mel)};segments={len(f.spans)};" in r.feature and "shape=16x24" in r.feature


def test_op5_against_brute_force(spark):
    got = queries.op5_ann(spark, SMALL).toPandas()
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding").toPandas()
    ids, x = rows.vec_id.to_numpy(), np.stack(rows.embedding.to_list()).astype(float)
    hits = total = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        want = [i for i in ids[np.lexsort((ids, d))] if i != q][:10]
        own = got[got.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, len(want) + 1)) and own.score.is_monotonic_increasing
        assert np.allclose(own.score, [d[ids == i][0] for i in own.vec_id], atol=1e-12)
        hits, total = hits + len(set(want) & set(own.vec_id)), total + len(want)
    assert hits >= 0.9 * total


def test_op9_predicts_held_out_rows(spark, small):
    lang = {d: x for d, _, x, _ in small}
    texts = {d: t for d, t, _, _ in small}
    rows = queries.op9_language(spark, SMALL).collect()
    assert len(rows) == len(small) and all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in texts[r.doc_id] or "")) for r in rows)
    asked = [r for r in rows if r.held_out and lang[r.doc_id] is not None and r.lang_pred != "und"]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in asked]) >= 0.95


def test_op10_contract(spark, small):
    rows = queries.op10_toxicity(spark, SMALL).collect()
    assert sorted(r.doc_id for r in rows) == sorted(d for d, _, _, _ in small)
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)


def test_toxicity_generalises_to_held_out_rows(spark):
    """At sf0.1, words of fewer than two fitted rows aside, nine in ten held-out toxic rows are found and few others."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").filter("toxic is not null").select("doc_id", "text", "lang", "toxic")
    rows = docs.orderBy("doc_id").collect()
    c, toxic, out = toxicity.ToxicityConfig(), np.array([r.toxic > 0 for r in rows]), np.array([held(r.doc_id) for r in rows])
    column = pa.array([r.text for r in rows])
    data = [(w[i:j], p[i:j]) for w, p, first in toxicity.word_features(column, c) for i, j in zip(first[:-1], first[1:], strict=True)]
    model = toxicity.train([data[i] for i in np.flatnonzero(~out)], toxic[~out].astype(np.float32), c)
    flagged = toxicity.score_column(column, model, toxicity._tables(model)) >= 0.3
    assert flagged[out & toxic].mean() >= 0.88
    assert flagged[out & ~toxic].mean() <= 0.02


def test_search_skips_lists_and_keeps_recall(spark):
    x = np.random.RandomState(2).normal(size=(20_000, 64))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got, hits = ann.search(df, F.col("vec_id") % 100 == 0).toPandas(), 0
    for q, g in got.groupby("query_id"):
        d = ((x.astype(float) - x[q].astype(float)) ** 2).sum(1)
        d[q] = np.inf
        hits += len(set(np.argsort(d)[:10]) & set(g.vec_id))
    assert hits >= 0.9 * 2000
    c = ann.SearchConfig()
    centroids = ann.kmeans(x[:8000].astype(float), 90, 4, 1)
    assert ann.needed_probes(x[:8000].astype(float), centroids, c) < 0.95 * len(centroids)


def test_search_keeps_rows_of_a_repeated_id(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.0, 1.0]), (5, [1.0, 0.1]), (5, [3.0, 0.1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 4)) for r in ann.search(df, F.col("vec_id") == 0).collect())
    first = [(0, 1, 0, 0.0), (0, 2, 5, 0.1), (0, 3, 0, 1.4142), (0, 4, 5, 2.0025)]
    other = [(0, 1, 5, 1.3454), (0, 2, 0, 1.4142), (0, 3, 0, 1.4142), (0, 4, 5, 3.1321)]
    assert got == sorted(first + first + other)


def test_count_tree_has_levels_and_prunes():
    """Families of near copies, and unrelated texts of one size: the tree leaves most pairs untested, and loses no link."""
    rng = np.random.RandomState(3)
    c, sets = jaccard.JaccardConfig(), []
    for _ in range(40):
        base = rng.randint(0, 1 << 62, 240).astype(np.uint64)
        for _ in range(15):
            own = base.copy()
            own[rng.permutation(240)[: rng.randint(0, 30)]] = rng.randint(0, 1 << 62)
            sets.append(np.unique(own))
    sets += [np.unique(rng.randint(0, 1 << 62, 240).astype(np.uint64)) for _ in range(200)]
    vectors = [jaccard.count_vector(x, len(x)) for x in sets]
    n = np.array([len(x) for x in sets])
    same = np.array([len(v) == len(vectors[0]) for v in vectors])
    assert same.all()
    tree = jaccard.CountTree(jaccard.unpack(vectors), n, np.arange(len(n)), np.zeros(len(n), int), c.num, c.leaf)
    found = {(min(i, j), max(i, j)) for a, b in tree.join(False) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
    linked = set()
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * both >= 75 * (n[i] + n[j] - both):
                linked.add((j, i))
    pairs = len(n) * (len(n) - 1) // 2
    print("levels", len(tree.levels), "tested", tree.tested, "passed", tree.passed, "pairs", pairs)
    assert linked <= found and len(tree.levels) >= 4
    assert tree.tested[-1] < 0.25 * pairs and sum(tree.tested) < 0.5 * pairs


def test_hot_buckets_are_dealt_by_size_bands(spark):
    rows = [("h", "s", i, n, i) for i, n in enumerate([100, 101, 130, 133, 134, 170, 400, 401, 3, 4])]
    df = spark.createDataFrame([(1, 2, *r[2:]) for r in rows], "home long, shingle long, node long, n long, root long")
    for limit in (1 << 20, 300, 16):
        tasks = {}
        for r in jaccard._placed(df, jaccard.JaccardConfig(block_bytes=limit)).collect():
            tasks.setdefault((r.home, r.lo, r.hi), set()).add((r.node, r.block))
        for _, _, i, n, _ in rows:
            for _, _, j, m, _ in rows:
                if i < j and min(n, m) * 100 >= max(n, m) * 75:
                    assert any({a for a, _ in t} >= {i, j} for t in tasks.values()), (limit, n, m)


def test_spans_are_decoded_alone(encoding):
    codec = bpe.codec(RANKS)
    text = "Hello, wörld! \U0001f600 " * 200
    ids = next(codec.encode([text]))
    offsets, raw, rng = codec.offsets(ids), text.encode(), random.Random(1)
    assert codec.place(ids, offsets) == raw
    for _ in range(200):
        a, b = sorted(rng.randint(0, len(raw) + 5) for _ in range(2))
        assert codec.span(ids, offsets, a, b) == raw[a:b]


def test_tensors_are_stored_with_their_shape():
    c = media.AudioConfig()
    loud = (128 + 100 * np.sin(np.arange(4000))).astype(np.uint8)
    f = media.features(np.concatenate([np.full(4000, 128, np.uint8), loud, np.full(4000, 128, np.uint8)]).tobytes(), c)
    back = media.StoredFeatures.read(f.stored())
    assert back.values.shape == (1, c.shape, c.bands) and np.array_equal(back.values, f.values) and np.array_equal(back.times, f.times)
    empty = media.StoredFeatures.read(media.features(bytes(64), c).stored())
    assert empty.values.shape[1:] == (c.shape, c.bands)


def test_feature_rows_know_their_shape(spark):
    df = spark.createDataFrame([(1, "abc" * 9000), (2, None)], "doc_id long, text string").withColumn("media", F.lit("clash"))
    out = media.audio_features(media.store_media(df, keep=("doc_id", "media")))
    assert out.schema["tensor"].metadata == {"shape": [16, 24]} and out.columns == ["doc_id", "segment", "start_s", "end_s", "tensor"]
    assert all(r.end_s > r.start_s and len(r.tensor) == 16 * 24 for r in out.collect())


def test_runs_name_their_source(spark):
    lines = [f"line {i} of the passage" for i in range(12)]
    rows = [(3, "\n".join(["own a", *lines[2:9], "own b"])), (1, "\n".join(lines)), (7, "\n".join([*lines[5:12], *lines[5:12]]))]
    got = sorted(tuple(r) for r in linededup.repeated_runs(spark.createDataFrame(rows, "doc_id long, text string"), 10).collect())
    assert got == [(3, 1, 7, 1, 2), (7, 0, 7, 1, 5), (7, 7, 7, 1, 5)]


def test_line_dedup_shuffles_where_deletions_are_many(spark, monkeypatch):
    rng = random.Random(9)
    pool = [" ".join(rng.choices("abcdefgh", k=6)) for _ in range(10)]
    df = spark.createDataFrame([(i, "\n".join(rng.choices(pool, k=12))) for i in range(50)], "doc_id long, text string")
    want = sorted(map(tuple, linededup.delete_repeated_runs(df, 12).collect()))
    monkeypatch.setattr(linededup, "BROADCAST_BYTES", -1)
    assert sorted(map(tuple, linededup.delete_repeated_runs(df, 12).collect())) == want


def test_language_sample_survives_a_hot_id(spark):
    rng = random.Random(5)
    words = {"en": ["the", "and", "house"], "de": ["und", "der", "haus"]}
    rows = [(i, " ".join(rng.choices(words[lang], k=20)), lang) for i, lang in enumerate(["en", "de"] * 60)] + [(None, "the same text and house", "en")] * 10_000
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.names == ["de", "en"] and len(model.centroids) <= 8
    assert language.predict_batch(["the house and", "und der haus"], model)[0] == ["en", "de"]


def test_toxicity_fit_survives_repeated_documents(spark):
    rows = [(i % 7, "idiot trash" if i % 7 == 3 else "fine words here", "en") for i in range(8000)]
    marks = [(i, int(i == 3)) for i in range(7)] * 50
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(marks, "doc_id long, toxic int"))
    assert 0 <= toxicity.score_column(pa.array(["idiot"]), model, toxicity._tables(model))[0] <= 1


def test_mixing_cut_is_exact_in_many_steps(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, rng.choice("aaab"), rng.randint(0, 9)) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    draw = mixing.draw_key(1, F.col("doc_id"))
    taken = []
    for bucket, digits in ((256, 2), (1, 1)):
        monkeypatch.setattr(mixing, "BUCKET_ROWS", bucket)
        monkeypatch.setattr(mixing, "DIGITS", digits)
        plan = mixing.plan_mix(df.select("source", "size", draw.alias("draw")), (5.0, 1.0), 1.2, 2)
        out = mixing.apply_mix(df, plan, F.col("source"), F.col("size"), draw).toPandas()
        taken.append(sorted(zip(out.doc_id, out["size"] * out.mix_copies + out.mix_part, strict=True)))
        for _, g in out.groupby("source"):
            assert abs((g["size"] * g.mix_copies + g.mix_part).sum() - g.mix_target.iloc[0]) <= 1
    assert taken[0] == taken[1]


ODD = ["_row", "_stays", "_words", "_draw", "_copy", "_mix_copies", "_extra", "lang_rejected", "_lang_pred", "n_lines", "n_removed", "_n_lines", "_doc_key", "_own", "_group", "mix_part"]


def test_stages_on_odd_tables(spark):
    """Clashing names, null and repeated ids, null, empty and very long texts, an empty table: columns and other values stay."""
    import corpus_pipeline

    rng = random.Random(21)
    words = [f"{a}{b}n" for a in "bcdfg" for b in "aeiou"]
    texts = [" ".join(rng.choices(words, k=60)) for _ in range(12)]
    texts += [None, "", "\n", "12 34", " ".join(rng.choices(words, k=60_000)), texts[0], texts[0]]
    ids = [*range(9), None, None, 3, *range(20, 20 + len(texts) - 12)]
    rows = [(i, t, "en", f"s{k % 3}" if k % 4 else None, *[f"{c}{k}" for c in ODD]) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in ODD))
    rest = {r[4:] for r in rows}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, SMALL)
        assert out.columns == df.columns, name
        got = [tuple(r) for r in out.collect()]
        assert {r[4:] for r in got} <= rest, name
        empty = stage(spark, df.limit(0), SMALL)
        assert empty.columns == df.columns and empty.count() == 0, name
        if name == "language_id":
            assert sorted(r[4] for r in got) == sorted(r[4] for r in rows if any(c.isalpha() for c in r[1] or ""))
        if name == "line_dedup":
            assert sum(r[1] is None for r in got) == 1 and len(got) == len(rows) - 2  # two later copies of a text lose all
        if name == "near_duplicates":
            assert Counter(r[1] for r in got) == Counter(set(t for t in texts))
    tokens = corpus_pipeline.STAGES[-1][1](spark, df, SMALL)
    assert tokens.count() == len(rows) and corpus_pipeline.STAGES[-1][1](spark, df.limit(0), SMALL).count() == 0


def test_pipeline_leaves_one_folder(spark, tmp_path, monkeypatch):
    import corpus_pipeline

    spark.createDataFrame([(i, f"some words here and there number {i} again", "en", "a") for i in range(20)], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr("canopy.storage.shared_folder", lambda _: (tmp_path / "shared").as_uri())
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    assert [p.name.split("-")[0] for p in (tmp_path / "shared").iterdir()] == ["mix_sources"]


def test_equal_names_are_found_free(spark):
    df = spark.range(1).withColumns({"_A": F.lit(1), "_a_": F.lit(1)})
    assert common.free_name(df, "_a") == "_a__"
