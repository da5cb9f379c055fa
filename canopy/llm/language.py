"""Language identification by nearest centroid over hashed, TF-IDF weighted character n-grams."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.llm.common import free_name, lean, ship_code

UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageConfig:
    """Parameters; ``per_language``, ``sample_rows`` and ``most_languages`` bound the labelled rows that centroids are fitted on."""

    features: int = 1 << 14
    longest: int = 3
    centroids: int = 4
    rounds: int = 8
    per_language: int = 400
    sample_rows: int = 20_000
    most_languages: int = 1000
    #: A text is rejected below this part of the similarity that all but ``outliers`` of its language's sample reach.
    slack: float = 0.5
    outliers: float = 0.002
    #: A text of fewer n-grams is rejected below a smaller part: cosines fall with the root of their number.
    full_grams: int = 150
    seed: int = 11


@dataclass(frozen=True)
class LanguageModel:
    """idf: a weight for each feature; centroids: unit rows; language: the row's language; radius: the least similarity accepted."""

    config: LanguageConfig
    idf: np.ndarray
    centroids: np.ndarray
    language: np.ndarray
    names: list[str] = field(default_factory=list)
    radius: np.ndarray = field(default_factory=lambda: np.zeros(0))


@cache
def _letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)])


def ngram_counts(text: str, c: LanguageConfig) -> np.ndarray | None:
    """Counts of hashed n-grams of 1 to ``longest`` letters, runs of other characters read as one blank; None without a letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return None
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    points = np.concatenate([[0], np.where(letter, points, 0)[keep], [0]]).astype(np.uint32)
    out = np.zeros(c.features)
    grams = np.zeros(len(points), np.uint32)
    for n in range(1, c.longest + 1):
        if len(points) < n:
            break
        grams = grams[: len(points) - n + 1] * np.uint32(0x01000193) + points[n - 1 :] + np.uint32(n)
        mixed = (grams ^ (grams >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        out += np.bincount((mixed >> np.uint32(8)) % np.uint32(c.features), minlength=c.features)
    return out


def vector(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """log(1 + count) * idf, at unit length."""
    v = np.log1p(counts) * idf
    norm = np.linalg.norm(v)
    return v / norm if norm else v


def _document_frequencies(docs: DataFrame, c: LanguageConfig) -> np.ndarray:
    """In how many of all given documents each feature occurs; the last entry is their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(c.features + 1, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts = ngram_counts(text, c) if text else None
                if counts is not None:
                    total[:-1] += counts > 0
                    total[-1] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["feature", "n"])

    out = np.zeros(c.features + 1, np.int64)
    # At most one row a feature reaches the driver.
    found = docs.select("text").mapInArrow(lean(run), "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    out[found["feature"].to_numpy()] = found["n"].to_numpy()
    return out


def _cluster(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Spherical k-means: unit centroids of the rows of x."""
    rng = np.random.RandomState(seed)
    centres = x[rng.permutation(len(x))[: min(k, len(x))]]
    for _ in range(rounds):
        nearest = (x @ centres.T).argmax(1)
        sums = np.stack([x[nearest == i].sum(0) if (nearest == i).any() else centres[i] for i in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres


def _sample(docs: DataFrame, c: LanguageConfig) -> tuple[DataFrame, list[str], int]:
    """(lang, text, _key): distinct (id, text) pairs in the order of a hash, the languages, and how many pairs each may have.

    A row's hash decides whether it is in the sample, by a threshold for its
    language that lets about ``each`` rows through; rows that repeat an id and a
    text are one, merged before the shuffle.  So no task meets a whole language.
    """
    sizes = docs.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "lang").limit(c.most_languages).collect()
    each = max(8, min(c.per_language, c.sample_rows // max(1, len(sizes))))
    # The key is spread evenly over 2**63 values; a fifth more than needed pass.
    limits = [(r["lang"], min((1 << 63) - 1, int((1 << 63) * min(1.0, 1.2 * (each + 40) / r["n"])))) for r in sizes]
    if not limits:
        return docs.select("lang", "text", F.lit(0).cast("long").alias("_key")).limit(0), [], each
    own = docs.sparkSession.createDataFrame(limits, "_lang string, _most long")  # most_languages rows
    key = F.xxhash64("doc_id", "text", F.lit(c.seed)).bitwiseAND(F.lit((1 << 63) - 1))
    chosen = docs.withColumn("_key", key).join(F.broadcast(own), (F.col("lang") == F.col("_lang")) & (F.col("_key") <= F.col("_most")))
    return chosen.groupBy("lang", "_key").agg(F.min("text").alias("text")).select("lang", "text", "_key"), sorted(r["lang"] for r in sizes), each


def fit(docs: DataFrame, config: LanguageConfig | None = None) -> LanguageModel:
    """(doc_id, text, lang) of labelled documents -> a model.

    Document frequencies count every given row.  Centroids are clustered on a
    bounded sample: the first (id, text) pairs of each language by a hash, at most
    ``per_language`` of one and ``sample_rows`` in all; ids may be null or
    repeated.  The ``most_languages`` most frequent values of lang are learned.
    Rows with null text, null lang or no letter teach nothing; without any row the
    model is empty.
    """
    c = config or LanguageConfig()
    ship_code(docs.sparkSession)
    docs = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    df = _document_frequencies(docs, c)
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1
    sample, names, each = _sample(docs, c)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(k).to_pylist() for k in range(3))
            rows = [(lang, key, np.flatnonzero(n), n[n > 0]) for lang, text, key in zip(*columns, strict=True) if (n := ngram_counts(text, c)) is not None]
            kinds = {"lang": pa.string(), "_key": pa.int64(), "at": pa.list_(pa.int32()), "n": pa.list_(pa.float64())}
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds.values())], names=list(kinds))

    centroids, language, radius, known = [], [], [], []
    # As Arrow: lists of boxed numbers would take several times the memory in both processes of the driver.
    # About 1.2 x sample_rows rows pass the thresholds; the limit bounds them for certain.
    rows = sample.mapInArrow(lean(vectors), "lang string, _key long, at array<int>, n array<double>").orderBy("_key", "lang").limit(2 * c.sample_rows).toArrow()
    of = np.array(rows["lang"].to_pylist(), object)
    for lang in names:
        own = rows.take(np.flatnonzero(of == lang)[:each])
        if not len(own):
            continue
        x = np.zeros((len(own), c.features), np.float32)
        for i, (at, n) in enumerate(zip(own["at"], own["n"], strict=True)):
            x[i, at.values.to_numpy()] = n.values.to_numpy()
        np.log1p(x, out=x)
        x *= idf.astype(np.float32)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        x = x[np.lexsort(x[:, :64].T)]  # the rows' order doesn't matter then
        centres = _cluster(x, c.centroids, c.rounds, c.seed)
        radius.append(c.slack * float(np.quantile((x @ centres.T).max(1), c.outliers)))
        centroids.append(centres)
        language += [len(known)] * len(centres)
        known.append(lang)
    matrix = np.concatenate(centroids).astype(np.float32) if centroids else np.zeros((0, c.features), np.float32)
    return LanguageModel(c, idf.astype(np.float32), matrix, np.array(language, np.int64), known, np.array(radius))


def predict_batch(texts: list[str | None], model: LanguageModel) -> tuple[list[str], list[float], list[bool]]:
    """For each text the nearest centroid's language, its cosine (0 to 1), and whether it lies too far from any."""
    langs, scores, rejected = [], [], []
    for text in texts:
        counts = ngram_counts(text, model.config) if text else None
        if counts is None or not len(model.centroids):
            langs.append(UNKNOWN)
            scores.append(0.0)
            rejected.append(True)
            continue
        near = model.centroids @ vector(counts, model.idf).astype(np.float32)
        best = int(near.argmax())
        lang = int(model.language[best])
        langs.append(model.names[lang])
        scores.append(float(min(1.0, max(0.0, near[best]))))
        rejected.append(bool(near[best] < model.radius[lang] * min(1.0, (counts.sum() / model.config.full_grams) ** 0.5)))
    return langs, scores, rejected


def identify(df: DataFrame, model: LanguageModel, keep: list[str] | None = None, text: str = "text", names: tuple[str, str, str] = ("lang_pred", "lang_score", "lang_rejected")) -> DataFrame:
    """The kept columns with lang_pred, lang_score and lang_rejected, or as ``names`` calls them; kept columns so called are replaced.

    Whole texts.  A null, empty or letterless text is `und`, scores 0 and is
    rejected; any other gets a learned language, rejected or not; of equally near
    centroids the first one's.  Repeated rows stay.  No shuffle.
    """
    ship_code(df.sparkSession)
    keep = [k for k in (df.columns if keep is None else keep) if k not in names]
    read = free_name(df, "_text")
    source = df.select(*keep, F.col(text).alias(read))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema.fields[:-1]) + ", ".join(f"`{n}` {kind}" for n, kind in zip(names, ("string", "double", "boolean"), strict=True))
    shared = df.sparkSession.sparkContext.broadcast(model)  # languages x centroids x features: bounded by the configuration

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = predict_batch(batch.column(read).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], pa.array(found[0], pa.string()), pa.array(found[1], pa.float64()), pa.array(found[2], pa.bool_())], names=[*keep, *names])

    return source.mapInArrow(lean(run), schema)
