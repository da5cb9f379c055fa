"""The corpus pipeline: language ID, line dedup, near duplicates, source mixing, tokens.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before
kept, and returns the columns of documents; the last returns tokens.  Stages tell
rows apart by position, never by doc_id alone, so ids may be null or repeated; an
empty table stays empty; columns beside doc_id, text, lang and source pass
through whatever they are called; whole texts are read, however long.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.llm import jaccard, language, linededup, mixing
from canopy.llm.common import WORD, free_name, free_names, held_out, materialise, scratch
from canopy.llm.queries import EPOCHS, MIN_WORDS, MIX_SEED, RANKS, SHARE, WEIGHTS, token_digests


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the texts that the language operator rejects: null, empty, letterless, or too far from every centroid.

    A text of few n-grams is judged by a smaller radius.  Without labelled rows
    every text is rejected, as there is no language.  Of repeated rows all stay or none.
    """
    model = language.fit(docs.filter(~held_out(F.col("doc_id"))))
    names = free_names(docs, "_lang_pred", "_lang_score", "_lang_rejected")
    return language.identify(docs, model, names=tuple(names)).filter(~F.col(names[2])).select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later copies of repeated line runs; a text that loses all its lines goes.

    The first place of a run is that of the smallest id (a null id first), and in
    a document the earliest.  Rows with equal id and text are one document and all
    stay alike.  Null and empty texts stay as they are.
    """
    lines, removed = free_names(docs, "_n_lines", "_n_removed")
    out = linededup.delete_repeated_runs(docs, MIN_WORDS, counts=(lines, removed)).filter((F.col(removed) == 0) | (F.col(removed) < F.col(lines)))
    return out.select([_length(docs, c) for c in docs.columns])


def _length(docs: DataFrame, name: str) -> Column:
    """n_chars follows the text."""
    return F.length("text").cast(docs.schema[name].dataType).alias(name) if name == "n_chars" else F.col(name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays: that of the smallest id, a null id last, the earliest of equals.

    Null texts and texts without words are near duplicates of nothing and stay.
    Repeated rows are copies: one stays.  Unrelated texts under one id stay both.
    """
    row, stays = free_names(docs, "_row", "_stays")
    keyed = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    found = jaccard.near_duplicates(keyed.select(F.col(row).alias("doc_id"), "text"))
    ids = keyed.select(F.col(row).alias("_own"), F.col("doc_id").alias("_id"))
    members = found.select(F.col("doc_id").alias("_own"), F.col("component_id").alias("_group")).join(ids, "_own")
    first = members.groupBy("_group").agg(F.min(F.struct(F.col("_id").isNull(), "_id", "_own")).alias("_first")).select(F.col("_first._own").alias(stays))
    return keyed.join(first, F.col(row) == F.col(stays), "left_semi").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents as the mix takes them, whole: the one at a source's boundary is taken where at least half of it belongs to the mix.

    A null source is a source of its own.  Texts without words weigh nothing and
    are taken as often as all of their source are.  The draw key ends with a key of
    the row's own, so rows never tie.
    """
    row, words, key = free_names(docs, "_row", "_words", "_draw")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    draw = F.concat(mixing.draw_key(MIX_SEED, F.col("doc_id"), F.xxhash64("text")), F.lpad(F.col(row).cast("string"), 19, "0"))
    keyed = materialise(docs.withColumn(row, F.monotonically_increasing_id()).withColumns({words: size, key: draw}), "sizes")
    plan = mixing.plan_mix(keyed.select("source", F.col(words).alias("size"), F.col(key).alias("draw")), WEIGHTS, SHARE, EPOCHS)
    prefix = "_mix"
    while any(c.lower().startswith(prefix) for c in keyed.columns):
        prefix += "_"
    mixed = mixing.apply_mix(keyed, plan, F.col("source"), F.col(words), F.col(key), prefix)
    copies, part = F.col(f"{prefix}_copies"), F.col(f"{prefix}_part")
    boundary = ((part > 0) & (2 * part >= F.col(words))).cast("long")
    copy = free_name(mixed, "_copy")
    mixed = mixed.withColumn(copy, F.explode(F.array_repeat(F.lit(0), (copies + boundary).cast("int"))))
    return mixed.select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: a row for each row of docs; null and empty texts have no tokens."""
    return token_digests(docs, public_tokenizers.path(RANKS))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("mix_sources", mix_sources),
    ("encode", encode),
]

#: SQL can't express the tokeniser or the classifier.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stored before the next; what a stage stores besides its result goes when it ends."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch(spark) as kept:
        for k, (name, stage) in enumerate(STAGES):
            if k + 1 == len(STAGES):
                kept.keep(docs)  # the last stage reads it when its rows are asked for
                return stage(spark, docs, sf_dir)
            with scratch(spark) as own:
                docs = own.keep(materialise(stage(spark, docs, sf_dir), name))
    raise AssertionError("there are no stages")
