"""Operator 3: benchmark decontamination by a prefix-filtered shingle join.

A benchmark item's windows are its runs of ``window`` words (an item of fewer
words is one window).  A window is contained in a document only if each of its
word shingles is, so one shingle is enough to find it: the rarest, by its
count in the documents (the prefix of the window's shingles in the order of
rarity that exact containment needs).  Documents offer their shingles on a
grid of every ``stride``-th position; each window keeps the rarest shingle of
each residue, so that whatever its place, one of its keys lies on the grid.
A shingle that no document has on the grid proves its windows absent there.

Candidates have to lie inside the document (positional bound) and their words
have to fit (length bound); then the window is compared word by word.

One pass reads the texts: it keeps, for grid positions whose shingle occurs in
the benchmark, the few words around.  The benchmark's shingles are joined by
broadcast in blocks of a checked row count; more shingles mean more blocks.

Defined results: null and empty texts have no words and no hits; empty tables
give no rows or no hits; repeated documents are judged one by one, repeated
items each count; input columns are only read by name, outputs replace them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from proofsheet.llm.text import n_spaced, row_key, spaced_words, split_spaced, text_hash
from proofsheet.session import saved

#: Benchmark shingles broadcast at once (8-byte hashes).
BLOCK_SHINGLES = 200_000


def _shingle(words: Column, at: Column, size: int) -> Column:
    return F.xxhash64(*[F.get(words, at + i) for i in range(size)])


def item_windows(items: DataFrame, window: int, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item, win, len): the windows of each item, as word arrays."""
    words = items.select(F.col(item_id).cast("string").alias("item"), split_spaced(spaced_words(F.col(text))).alias("words"))
    words = words.where(F.size("words") > 0).withColumn("len", F.least(F.size("words"), F.lit(window)))
    starts = F.explode(F.sequence(F.lit(0), F.size("words") - F.col("len")))
    return words.withColumn("at", starts).select("item", F.slice("words", F.col("at") + 1, F.col("len")).alias("win"), "len").distinct()


def _window_shingles(windows: DataFrame, size: int, stride: int) -> DataFrame:
    """(win, len, offset, residue, h) for each shingle of each distinct window."""
    at = F.explode(F.sequence(F.lit(0), F.col("len") - size))
    return (windows.select("win", "len").distinct().withColumn("offset", at)
            .withColumn("residue", F.col("offset") % stride)
            .withColumn("h", _shingle(F.col("win"), F.col("offset"), size)))


def _grid_matches(words: DataFrame, shingles: DataFrame, window: int, size: int, stride: int, first: bool) -> DataFrame:
    """Grid positions whose shingle the benchmark has, with the words around;
    with ``first``, also one row (pos -1) for each document."""
    block = shingles.select("h", F.lit(True).alias("__in"))
    grid = F.when(F.col("n_words") >= size, F.sequence(F.lit(0), (F.col("n_words") - size).cast("int"), F.lit(stride))).otherwise(
        F.array().cast("array<int>"))
    if first:
        grid = F.concat(F.array(F.lit(-1)), grid)
    reach = window - size
    rows = (words.withColumn("pos", F.explode(grid)).withColumn("h", _shingle(F.col("words"), F.col("pos"), size))
            .join(F.broadcast(block), "h", "left").where(F.col("__in") | (F.col("pos") < 0)))
    from_ = F.greatest(F.col("pos") - reach, F.lit(0))
    around = F.when(F.col("pos") >= 0, F.slice("words", from_ + 1, F.col("pos") - from_ + window))
    return rows.select("rk", "id", "text_hash", "n_words", "pos", "h", from_.alias("from_"), around.alias("around"))


def _occurrences(matches: DataFrame, shingles: DataFrame) -> DataFrame:
    """(rk, start, len, win) of windows found in documents, via each window's rarest shingles."""
    counts = matches.groupBy("h").agg(F.count("*").alias("n"))
    # a shingle that no document has on its grid proves the window absent at that residue
    rarest = (shingles.join(counts, "h", "left")
              .withColumn("n", F.coalesce("n", F.lit(0)))
              .groupBy("win", "len", "residue").agg(F.min_by(F.struct("h", "offset", "n"), F.struct("n", "offset")).alias("k"))
              .where("k.n > 0").select("win", "len", F.col("k.h").alias("h"), F.col("k.offset").alias("offset")))
    found = matches.join(rarest, "h").withColumn("start", F.col("pos") - F.col("offset"))
    found = found.where((F.col("start") >= 0) & (F.col("start") + F.col("len") <= F.col("n_words")))
    same = F.slice("around", F.col("start") - F.col("from_") + 1, F.col("len")) == F.col("win")
    return found.where(same).select("rk", "start", "len", "win").distinct()


def contaminated_spans(docs: DataFrame, items: DataFrame, window: int = 10, size: int = 3, stride: int = 4,
                       doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                       item_text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents: rk, id, text_hash, n_words; occurrences: rk, start, len, win; windows: item, win, len).

    ``rk`` numbers the documents' rows."""
    windows = saved(item_windows(items, window, item_id, item_text))
    # a window shorter than a shingle and its grid goes by single words on the full grid
    least = size + stride - 1
    scans = []  # (shingles of a group of windows, shingle length, stride, hashes of one block)
    for s, step, which in [(size, stride, F.col("len") >= least), (1, 1, F.col("len") < least)]:
        shingles = saved(_window_shingles(windows.where(which), s, step))
        hashes = shingles.select("h").distinct()
        blocks = -(-hashes.count() // BLOCK_SHINGLES) or (0 if scans else 1)
        scans += [(shingles, s, step, hashes.where(F.pmod("h", F.lit(blocks)) == b)) for b in range(blocks)]

    words = docs.select(F.monotonically_increasing_id().alias("rk"), F.col(doc_id).alias("id"),
                        text_hash(F.col(text)).alias("text_hash"), spaced_words(F.col(text)).alias("spaced"))
    if len(scans) > 1:
        words = saved(words)  # row numbers have to agree between the scans
    words = words.select("rk", "id", "text_hash", n_spaced(F.col("spaced")).alias("n_words"), split_spaced(F.col("spaced")).alias("words"))
    tables = [saved(_grid_matches(words, hashes, window, s, step, at == 0)) for at, (_, s, step, hashes) in enumerate(scans)]
    hits = None
    for s in dict.fromkeys(s for _, s, _, _ in scans):
        own = [(table.where("pos >= 0"), shingles, step) for table, (shingles, length, step, _) in zip(tables, scans) if length == s]
        found = _occurrences(reduce(DataFrame.unionByName, [m for m, _, _ in own]), own[0][1])
        hits = found if hits is None else hits.unionByName(found).distinct()
    rows = tables[0].where("pos < 0").select("rk", "id", "text_hash", "n_words")
    return rows, saved(hits), windows


def covered_words(spans: DataFrame) -> DataFrame:
    """(rk, n_hit): words inside any span, each counted once."""
    w = W.partitionBy("rk").orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1)
    spans = spans.select("rk", F.col("start"), (F.col("start") + F.col("len")).alias("end")).distinct()
    return (spans.withColumn("seen", F.coalesce(F.max("end").over(w), F.lit(0)))
            .groupBy("rk").agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", "seen"))).cast("long").alias("n_hit")))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, doc_id: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items_sha256, contaminated."""
    rows, hits, windows = contaminated_spans(docs, items, window, doc_id=doc_id, text=text, item_id=item_id, item_text=item_text)
    found = (hits.select("rk", "win").distinct().join(windows.select("item", "win"), "win")
             .groupBy("rk").agg(F.sort_array(F.collect_set("item")).alias("items")))
    out = rows.join(covered_words(hits), "rk", "left").join(found, "rk", "left")
    items_col = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(F.col("id").alias(doc_id), "n_words", n_hit.alias("n_hit"), F.size(items_col).cast("long").alias("n_items"),
                      F.sha2(F.array_join(items_col, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = 10, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without those that hold a window of a benchmark item."""
    rows, hits, _ = contaminated_spans(docs, items, window, doc_id=doc_id, text=text)
    bad = saved(rows.join(hits.select("rk").distinct(), "rk", "left_semi").select(row_key(F.col("id"), F.col("text_hash")).alias("__key")).distinct())
    return docs.withColumn("__key", row_key(F.col(doc_id), text_hash(F.col(text)))).join(bad, "__key", "left_anti").drop("__key")
