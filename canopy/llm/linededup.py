"""Line dedup: a suffix array over line-ID sequences, built by distributed prefix doubling in DataFrame functions.

A text is the sequence of its lines (cut at "\\n").  A run of consecutive lines
that also occurs earlier - in a document of smaller id, or before in the same
one - is deleted where it recurs, if it has at least ``min_words`` words, an
empty line counting one.  Runs are maximal: whatever lies in some such run goes.

Lines that occur once break runs, and what lies between them is a segment: only
segments of enough words are sorted.  A suffix is ranked by its first 1, 2, 4,
... lines; suffixes that tie at a depth form an interval of the suffix array
whose members' longest common prefix has that many lines at least (an LCP
interval), and a rank is the interval's left end.  A prefix of any length between
two depths is named by the ranks of its two overlapping halves, so its LCP
interval is a group too.  Every maximal run is covered by its prefixes of just
``min_words`` words: the shortest from each start and the shortest that reaches
each end, so doubling stops at the longest of those.  The interval of each such
prefix holds all its copies; the first by position stays, and each later one is
joined, along its diagonal of copy and source, with its neighbours to a maximal
run.

Lines are told apart by 128 bits of two hashes, so at 1e11 different lines the
odds of any collision are below 1e-16.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopy.llm.common import WORD, free_name, free_names, materialise, scratch

#: Ranks summed in one task, about, when a rank's left end is counted.
STRETCH = 1 << 16
#: Bytes of deletions that may be broadcast to the texts; beyond, the texts are shuffled to them.
BROADCAST_BYTES = 16 << 20
NULL_ID = -(1 << 63)

_DOC = ["_d", "_t"]
_LINE = ["_h", "_h2"]


def _before(df: DataFrame, group: list[str], order: list[str], weight: str, into: str) -> DataFrame:
    """df with the sum of ``weight`` over the rows of its group that come before it by ``order`` (longs, unique there).

    Summed in two steps, over stretches of the order and within each, so that no
    task sorts a large group.  Hashes are cut to stretches by their upper bits.
    """
    stretch = F.shiftright(F.col("_h"), 48) if order == _LINE else F.floor(F.col(order[0]) / F.lit(STRETCH)).cast("long")
    df = df.withColumn("_stretch", stretch)
    inner = Window.partitionBy(*group, "_stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    outer = (Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*group, "_stretch").agg(F.sum(weight).alias("_sum"))
    base = sums.select(*group, "_stretch", F.coalesce(F.sum("_sum").over(outer), F.lit(0)).alias("_base"))
    out = df.join(base, [*group, "_stretch"]).withColumn(into, F.col("_base") + F.coalesce(F.sum(weight).over(inner), F.lit(0)))
    return out.drop("_stretch", "_base")


def _id(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(NULL_ID))


def _lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(_d, _t, _i, _h, _h2, _w): each line of each (id, text), its hashes, and its words, 1 at least."""
    read = docs.select(_id(F.col(doc_id)).alias("_d"), F.xxhash64(text).alias("_t"), F.split(text, "\n").alias("_lines")).filter(F.col("_lines").isNotNull())
    rows = read.select(*_DOC, F.posexplode("_lines").alias("_i", "_line"))
    words = F.greatest(F.lit(1), F.regexp_count("_line", F.lit(WORD))).cast("long")
    # A second seed comes first: the hash of a column goes on from that of the one before.
    return rows.select(*_DOC, F.col("_i").cast("long").alias("_i"), F.xxhash64("_line").alias("_h"), F.xxhash64(F.lit(1), "_line").alias("_h2"), words.alias("_w"))


def _positions(docs: DataFrame, min_words: int, doc_id: str, text: str) -> DataFrame:
    """(_d, _t, _i, _seg, _w, _c, r0): lines of segments that hold min_words words at least; _c counts the segment's words before a line."""
    lines = materialise(_lines(docs, doc_id, text), "lines")
    counts = materialise(lines.groupBy(*_LINE).agg(F.count("*").alias("_n")).filter("_n > 1"), "repeated")
    first = materialise(_before(counts, [], _LINE, "_n", "r0").select(*_LINE, "r0"), "ranks")
    live = lines.join(first, _LINE).dropDuplicates([*_DOC, "_i"]).select(*_DOC, "_i", "_w", "r0")
    # A segment is a stretch of consecutive repeated lines.
    in_doc = Window.partitionBy(*_DOC).orderBy("_i")
    live = live.withColumn("_seg", F.col("_i") - F.row_number().over(in_doc)).withColumn("_w", F.least("_w", F.lit(min_words)))
    in_seg = Window.partitionBy(*_DOC, "_seg").orderBy("_i")
    whole = in_seg.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    live = live.withColumns({"_c": F.sum("_w").over(in_seg) - F.col("_w"), "_all": F.sum("_w").over(whole)})
    return live.filter(F.col("_all") >= min_words).drop("_all")


def _double(at: DataFrame, depth: int) -> DataFrame:
    """Positions with ranks by 2**(depth+1) lines, from those by 2**depth.

    The rank of a pair is the old rank plus the number of suffixes in the old
    interval whose second half ranks lower (-1: past the segment's end).  Pairs
    are counted before they are sorted, so a hot line is one row for each of its
    followers.
    """
    r = f"r{depth}"
    shifted = at.select(*_DOC, (F.col("_i") - (1 << depth)).alias("_i"), F.col(r).alias("_r2"), F.col("_seg").alias("_seg2"))
    pairs = at.join(shifted, [*_DOC, "_i"], "left").withColumn("_r2", F.when(F.col("_seg") == F.col("_seg2"), F.col("_r2")).otherwise(F.lit(-1).cast("long"))).drop("_seg2")
    pairs = materialise(pairs, "pairs")
    counted = pairs.groupBy(r, "_r2").agg(F.count("*").alias("_n"))
    ranked = materialise(_before(counted, [r], ["_r2"], "_n", "_off").select(r, "_r2", (F.col(r) + F.col("_off")).alias(f"r{depth + 1}")), "ranks")
    return pairs.join(ranked, [r, "_r2"]).drop("_r2")


def _prefixes(at: DataFrame, min_words: int) -> DataFrame:
    """(_d, _t, _s, _m): of each segment the shortest prefixes of min_words words from each start, and the shortest that reach each end."""
    # Words are capped at min_words, so the first mark at least that far off lies less than twice as far.
    ends = at.groupBy(*_DOC, "_seg").agg((F.max("_i") + 1).alias("_i"), F.max(F.col("_c") + F.col("_w")).alias("_c"))
    marks = at.select(*_DOC, "_seg", "_i", "_c").unionByName(ends)
    by_words = Window.partitionBy(*_DOC, "_seg").orderBy("_c")
    to = F.min("_i").over(by_words.rangeBetween(min_words, 2 * min_words))
    since = F.max("_i").over(by_words.rangeBetween(-2 * min_words, -min_words))
    spans = marks.select(*_DOC, "_i", to.alias("_to"), since.alias("_since"))
    both = F.array(F.struct(F.col("_i").alias("_s"), F.col("_to").alias("_e")), F.struct(F.col("_since").alias("_s"), F.col("_i").alias("_e")))
    rows = spans.select(*_DOC, F.explode(both).alias("_x")).select(*_DOC, "_x._s", (F.col("_x._e") - F.col("_x._s")).alias("_m"))
    return rows.filter("_m > 0").distinct()


def _later_copies(docs: DataFrame, min_words: int, doc_id: str, text: str) -> DataFrame:
    """(_d, _t, _s, _m, _first): prefixes that occur earlier, and the first place (document, text, line) of each."""
    spark = docs.sparkSession
    at = materialise(_positions(docs, min_words, doc_id, text), "positions")
    prefixes = materialise(_prefixes(at, min_words), "prefixes")
    longest = prefixes.agg(F.max("_m")).first()[0] or 1
    depth = 0
    while 2 << depth <= longest:
        with scratch(spark) as own:
            at = own.keep(materialise(_double(at, depth), "positions"))
        depth += 1
    ranks = F.array(*[F.col(f"r{k}") for k in range(depth + 1)])
    table = at.select(*_DOC, "_i", ranks.alias("_ranks"))
    level = F.floor(F.log2(F.col("_m").cast("double")) + 1e-9).cast("int")
    head = prefixes.withColumn("_level", level).join(table.withColumnRenamed("_i", "_s"), [*_DOC, "_s"])
    second = F.col("_s") + F.col("_m") - F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_level"))
    head = head.select(*_DOC, "_s", "_m", "_level", F.element_at("_ranks", F.col("_level") + 1).alias("_a"), second.alias("_i"))
    named = head.join(table, [*_DOC, "_i"]).select(*_DOC, "_s", "_m", "_a", F.element_at("_ranks", F.col("_level") + 1).alias("_b"))
    named = materialise(named, "named")
    place = F.struct("_d", "_t", "_s")
    intervals = materialise(named.groupBy("_m", "_a", "_b").agg(F.min(place).alias("_first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n"), "intervals")
    return named.join(intervals, ["_m", "_a", "_b"]).filter(place != F.col("_first")).select(*_DOC, "_s", "_m", "_first")


def _islands(df: DataFrame, group: list[str]) -> DataFrame:
    """(group, _s, _e): the unions of the overlapping or touching spans [_s, _e) of each group."""
    order = Window.partitionBy(*group).orderBy("_s", "_e")
    reach = F.max("_e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("_new", F.when(reach.isNull() | (F.col("_s") > reach), 1).otherwise(0))
    numbered = marked.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(*group, "_island").agg(F.min("_s").alias("_s"), F.max("_e").alias("_e")).drop("_island")


def _runs(docs: DataFrame, min_words: int, doc_id: str, text: str) -> DataFrame:
    """(_d, _t, _s, _e, _from_d, _from_t, _off): maximal runs of lines _s to _e that copy those ``_off`` lines before in the source."""
    later = _later_copies(docs, min_words, doc_id, text)
    own = later.select(*_DOC, "_s", (F.col("_s") + F.col("_m")).alias("_e"), F.col("_first._d").alias("_from_d"), F.col("_first._t").alias("_from_t"), (F.col("_s") - F.col("_first._s")).alias("_off"))
    return _islands(own, [*_DOC, "_from_d", "_from_t", "_off"])


def repeated_runs(docs: DataFrame, min_words: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, first_line, n_lines, source_id, source_line: every maximal run of lines that copies an earlier one.

    A run of several sources has a row for each stretch that one source's first
    place serves.  Lines count from 0.  Rows with equal id and text are one
    document; a null id comes before all others; a null text has no lines.
    """
    ids = [F.nullif(c, F.lit(NULL_ID)) for c in (F.col("_d"), F.col("_from_d"))]
    return _runs(docs, min_words, doc_id, text).select(ids[0].alias("doc_id"), F.col("_s").alias("first_line"), (F.col("_e") - F.col("_s")).alias("n_lines"), ids[1].alias("source_id"), (F.col("_s") - F.col("_off")).alias("source_line"))


def repeated_lines(docs: DataFrame, min_words: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(_d, _t, _gone): for each document with any, the disjoint spans (s, e) of lines to delete, ascending; _t is xxhash64 of the text."""
    spans = _islands(_runs(docs, min_words, doc_id, text).select(*_DOC, "_s", "_e"), _DOC)
    return spans.groupBy(*_DOC).agg(F.sort_array(F.collect_list(F.struct(F.col("_s").alias("s"), F.col("_e").alias("e")))).alias("_gone"))


def delete_repeated_runs(docs: DataFrame, min_words: int = 50, doc_id: str = "doc_id", text: str = "text", counts: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """docs with the text without its later copies of repeated runs, and n_lines, n_removed (0 and 0 for a null text), or as ``counts`` calls them.

    Kept lines stay in their order, joined by "\\n"; a text that loses all its
    lines is empty.  Every line keeps its first occurrence.  Empty texts have one
    line.  Rows with equal id and text are one document and stay alike; a null id
    comes before all others.  Columns of docs that are called like the new ones
    are replaced.
    """
    docs = docs.drop(*[c for c in counts if c != text])
    d, t, lines, of_d, of_t, gone = free_names(docs, "_doc_key", "_text_key", "_lines", "_gone_doc", "_gone_text", "_gone_spans")
    with scratch(docs.sparkSession) as own:
        found = own.keep(materialise(repeated_lines(docs, min_words, doc_id, text), "gone"))
    rows, spans = found.agg(F.count("*"), F.coalesce(F.sum(F.size("_gone")), F.lit(0))).first()
    found = found.toDF(of_d, of_t, gone)
    # Deletions of few documents go to the texts; else both are shuffled.
    found = F.broadcast(found) if 32 * rows + 16 * spans <= BROADCAST_BYTES else found
    keyed = docs.withColumns({d: _id(F.col(doc_id)), t: F.xxhash64(text)})
    both = keyed.join(found, (F.col(d) == F.col(of_d)) & (F.col(t) == F.col(of_t)), "left").withColumn(lines, F.split(text, "\n"))
    n = F.size(lines)
    kept = F.filter(F.sequence(F.lit(0).cast("long"), (n - 1).cast("long")), lambda i: ~F.exists(gone, lambda x: (x["s"] <= i) & (i < x["e"])))
    body = F.array_join(F.transform(kept, lambda i: F.get(F.col(lines), i.cast("int"))), "\n")
    new = F.when(F.col(gone).isNull(), F.col(text)).otherwise(body)
    removed = F.aggregate(gone, F.lit(0).cast("long"), lambda total, x: total + x["e"] - x["s"])
    out = [new.alias(c) if c == text else F.col(c) for c in docs.columns]
    return both.select(*out, F.when(F.col(lines).isNull(), F.lit(0)).otherwise(n).cast("long").alias(counts[0]), F.coalesce(removed, F.lit(0)).cast("long").alias(counts[1]))
