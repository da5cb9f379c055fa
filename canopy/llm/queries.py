"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.llm import ann, bpe, counts, jaccard, language, linededup, media, mixing, sharding, toxicity
from canopy.llm.common import WORD, held_out, lean, materialise, read_table, ship_code

RANKS = "byte_bpe_50k.tiktoken"
SHARDS, SHARD_SEED = 8, 17
WEIGHTS, SHARE, EPOCHS, MIX_SEED = (5.0, 2.0, 1.0), 1.5, 2, 29
MIN_WORDS = 50
TOXIC_AT = 0.3


def token_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: texts encoded, and decoded again by the tokens' offsets.

    Null and empty texts have no tokens.  Repeated rows each get a row; other
    columns of docs don't matter.
    """
    ship_code(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = bpe.codec(path)
        for batch, chunks in bpe.encode_batches(batches, path, "text"):
            n, joined, decoded = [], [], []
            for ids, first in chunks:
                offsets = codec.offsets(ids)
                ends = np.append(offsets, offsets[-1] + codec.lengths[ids[-1]] if len(ids) else 0)[first].tolist()
                text = memoryview(codec.place(ids, offsets))
                for (a, b), (x, y) in zip(pairwise(first.tolist()), pairwise(ends), strict=True):  # one text at a time: lists of ids are large
                    n.append(b - a)
                    joined.append(hashlib.sha256(" ".join(map(codec.decimals.__getitem__, ids[a:b].tolist())).encode()).hexdigest())
                    decoded.append(hashlib.sha256(text[x:y]).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(joined, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(read_table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law `rows`: a Feistel permutation of row numbers in the order of doc_id (ties by checksum and size)."""
    docs = read_table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    placed = sharding.shard_rows(rows, ["doc_id", "text_crc32", "size"], SHARDS, SHARD_SEED)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(media.store_media(read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")))


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(read_table(spark, sf_dir, "documents"))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), mixing.draw_key(MIX_SEED, F.col("doc_id")).alias("draw"))
    rows = materialise(rows, "sizes")
    plan = mixing.plan_mix(rows.select("source", "size", "draw"), WEIGHTS, SHARE, EPOCHS)
    mixed = mixing.apply_mix(rows, plan, F.col("source"), F.col("size"), F.col("draw"))
    return mixed.select("doc_id", "size", F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("size") * F.col("mix_copies") + F.col("mix_part")).alias("taken"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.length_histogram(counts.token_lengths(read_table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS)))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = linededup.delete_repeated_runs(docs, MIN_WORDS)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs.filter(~held_out(F.col("doc_id"))))
    out = language.identify(docs, model, keep=["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    model = toxicity.fit(docs.filter(~held_out(F.col("doc_id"))), read_table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id"))))
    at = F.create_map(*[x for k, v in sorted(model.thresholds.items()) for x in (F.lit(k), F.lit(v))]) if model.thresholds else None
    out = toxicity.score(docs, model, keep=["doc_id", "lang"])
    own = F.lit(TOXIC_AT) if at is None else F.coalesce(F.element_at(at, F.col("lang")), F.lit(TOXIC_AT))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= TOXIC_AT).cast("int").alias("predicted"), (F.col("toxic_score") >= own).alias("flagged"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bpe, op2_sharding, op3_audio, op4_jaccard, op5_ann, op6_mixing, op7_token_counts, op8_line_dedup, op9_language, op10_toxicity)}


MIX_SQL = f"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size,
         md5('{MIX_SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS draw
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM s),
r AS (SELECT *, {EPOCHS} * source_size AS cap, {EPOCHS} * source_size / weight AS ratio FROM w),
c AS (
  SELECT *, row_number() OVER o AS k,
         ({SHARE}::DOUBLE * (SELECT sum(source_size) FROM s) - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / ((SELECT sum(weight) FROM r) - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM r WINDOW o AS (ORDER BY ratio, source NULLS LAST)),
f AS (SELECT k AS first_k, level AS free FROM c WHERE ratio > level ORDER BY k LIMIT 1),
t AS (
  SELECT source, source_size, first_k IS NULL OR k < first_k AS capped,
         CASE WHEN first_k IS NULL OR k < first_k THEN CAST(cap AS DOUBLE) ELSE free * weight END AS target
  FROM c LEFT JOIN f ON true),
p AS (
  SELECT *, CASE WHEN capped THEN {EPOCHS} WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
q AS (SELECT *, CASE WHEN capped THEN 0 ELSE CAST(round(target - whole * source_size) AS BIGINT) END AS more FROM p),
u AS (
  SELECT d.*, q.source_size, q.target, q.whole, q.more,
         sum(size) OVER (PARTITION BY d.source ORDER BY draw RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         sum(size) OVER (PARTITION BY d.source, draw) AS tied
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target,
       CAST(whole * size + CASE WHEN upto <= more THEN size WHEN upto - tied < more THEN size * (more - upto + tied) // tied ELSE 0 END AS BIGINT) AS taken
FROM u
"""

LINES_SQL = f"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM d),
w AS (
  SELECT *, least({MIN_WORDS}, greatest(1, len(regexp_extract_all(line, '{WORD}')))) AS w FROM l),
m AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM w),
n AS (
  SELECT a.doc_id, a.i AS s, b.i AS e FROM m a JOIN m b ON a.doc_id = b.doc_id AND b.i BETWEEN a.i AND a.i + {MIN_WORDS} - 1
  WHERE b.upto - a.upto + a.w >= {MIN_WORDS} AND (b.upto - b.w - a.upto + a.w < {MIN_WORDS} OR b.upto - a.upto < {MIN_WORDS})),
x AS (SELECT n.doc_id, s, e, array_to_string(d.lines[s + 1:e + 1], chr(10)) AS body, e - s AS m FROM n JOIN d USING (doc_id)),
y AS (SELECT *, row_number() OVER (PARTITION BY m, body ORDER BY doc_id, s) AS k FROM x),
g AS (SELECT DISTINCT doc_id, unnest(range(s, e + 1)) AS i FROM y WHERE k > 1),
z AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.i) AS n_removed, string_agg(CASE WHEN g.i IS NULL THEN line END, chr(10) ORDER BY l.i) AS body
  FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(body, '')) END AS text_sha256
FROM d LEFT JOIN z USING (doc_id)
"""

JACCARD_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(greatest(1, len(w) - 4))) AS i FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1:i + 5], ' ') AS g FROM p),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * n_both >= 75 * (x.n + y.n - n_both)),
c AS (SELECT doc_id AS node, doc_id AS reached FROM d UNION SELECT c.node, e.b FROM c JOIN e ON c.reached = e.a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, r.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT node, min(reached) AS component_id FROM c GROUP BY node) r ON r.node = d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    """For the operators that SQL can express; the others are tested against brute force."""
    return {"op4_jaccard": JACCARD_SQL, "op6_mixing": MIX_SQL, "op8_line_dedup": LINES_SQL}
