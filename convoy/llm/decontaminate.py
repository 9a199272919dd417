"""Benchmark decontamination: a set join on rare shingles, then exact comparison of word windows.

A window is ``WINDOW`` consecutive words of an item. To hold a window, a document must hold all of its
shingles, so one shingle is a sufficient prefix under any order; the rarest in the documents makes
the fewest candidates. Where that shingle stands bounds where the window would begin and end;
windows that would not fit are dropped, the others compared word by word. DataFrame operations only.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

from convoy.llm.common import stage, text_key

WINDOW = 10
SHINGLE = 5
#: Rows of benchmark shingles up to which that side of a join is broadcast; beyond it both sides shuffle.
BROADCAST_ROWS = 500_000
#: ASCII characters that are neither digits nor small letters part words.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: str = "text") -> Column:
    """Words of a text with A-Z in lower case; null has none."""
    lowered = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(F.array_remove(F.split(lowered, BREAKS), ""), F.array().cast("array<string>"))


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, words) of every window; an item of fewer words is one window, without words none."""
    rows = items.select("item_id", words_of().alias("all")).where(F.size("all") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("all") - window + 1, F.lit(1)))
    return rows.select("item_id", "all", F.explode(starts).alias("at")).select("item_id", F.slice("all", F.col("at"), window).alias("words"))


def window_shingles(windows: DataFrame) -> DataFrame:
    """(wid, words, offset, width, shingle): all shingles of every distinct window."""
    distinct = windows.select(F.xxhash64("words").alias("wid"), "words", F.least(F.size("words"), F.lit(SHINGLE)).alias("width")).distinct()
    places = F.sequence(F.lit(0), F.size("words") - F.col("width"))
    placed = distinct.select("*", F.explode(places).alias("offset"))
    return placed.withColumn("shingle", F.xxhash64("width", F.slice("words", F.col("offset") + 1, F.col("width"))))


def document_shingles(docs: DataFrame, widths: list[int]) -> DataFrame:
    """(doc_id, key, n_words, pos, shingle) of every shingle of the given widths."""
    tokens = docs.select("doc_id", text_key().alias("key"), words_of().alias("words")).withColumn("n_words", F.size("words"))

    def hashes_of(width: int) -> Column:
        places = F.sequence(F.lit(1), F.col("n_words") - width + 1)
        return F.transform(places, lambda i: F.xxhash64(F.lit(width), F.slice("words", i, width)))

    out = None
    for width in widths:
        hashes = hashes_of(width)
        rows = tokens.where(F.col("n_words") >= width).select("doc_id", "key", "n_words", F.posexplode(hashes).alias("pos", "shingle"))
        out = rows if out is None else out.unionAll(rows)
    return out


def bounded(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Marked for broadcast if a count shows that it has at most ``most`` rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def find_items(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of ``docs``: doc_id, key (hash of the text), n_words, n_hit (long), items (array of item_id, sorted as text).

    ``docs`` has doc_id and text, ``items`` has item_id and text. n_hit counts the words of a document
    that lie in any occurrence of a window, each once. Null and empty texts have no words and hold
    nothing. Items with equal windows are all listed; a null item_id is never listed. Rows of one
    doc_id and different texts are judged apart, equal rows alike and once for each. Other columns are
    neither read nor returned. Without items nothing is hit.
    """
    windows = stage(item_windows(items, window), "windows")
    shingles = stage(window_shingles(windows), "window-shingles")
    widths = sorted(r.width for r in shingles.select("width").distinct().collect())  # SHINGLE values at most
    tokens = document_shingles(docs, widths or [SHINGLE])
    # documents are cut into shingles once; what meets a benchmark shingle serves the order and the join
    met = stage(tokens.join(bounded(shingles.select("shingle").distinct()), "shingle"), "shingles-met")
    seen = met.groupBy("shingle").agg(F.count("*").alias("seen"))
    # a shingle that no document has rules its windows out; of the others the rarest is the prefix
    ranked = shingles.join(seen, "shingle", "left").withColumn("seen", F.coalesce("seen", F.lit(0)))
    prefix = (
        ranked.groupBy("wid", "words")
        .agg(F.min(F.struct("seen", "shingle", "offset")).alias("rarest"))
        .where("rarest.seen > 0")
        .select("wid", "words", "rarest.shingle", "rarest.offset")
    )
    prefix = bounded(stage(prefix, "window-prefix"))
    start = F.col("pos") - F.col("offset")
    candidates = (
        met.join(prefix, "shingle")
        .where((start >= 0) & (start + F.size("words") <= F.col("n_words")))
        .groupBy(F.col("doc_id").alias("_id"), F.col("key").alias("_key"))
        .agg(F.collect_set(F.struct(start.alias("start"), "wid", "words")).alias("_near"))
    )
    rows = docs.select("doc_id", text_key().alias("key"), "text")
    joined = rows.join(candidates, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left")
    spoken = joined.select("doc_id", "key", words_of().alias("words"), "_near")
    exact = F.filter("_near", lambda c: F.slice("words", c["start"] + 1, F.size(c["words"])) == c["words"])
    checked = spoken.select("doc_id", "key", F.size("words").cast("long").alias("n_words"), exact.alias("_hits"))
    covered = F.array_distinct(F.flatten(F.transform("_hits", lambda c: F.sequence(c["start"], c["start"] + F.size(c["words"]) - 1))))
    found = checked.select(
        "doc_id", "key", "n_words",
        F.coalesce(F.when(F.col("_hits").isNotNull(), F.size(covered)), F.lit(0)).cast("long").alias("n_hit"),
        F.array_distinct(F.col("_hits.wid")).alias("wids"),
    )
    found = stage(found, "items-found")
    owners = windows.where("item_id IS NOT NULL").select(F.xxhash64("words").alias("wid"), "item_id").distinct()
    listed = (
        found.where("n_hit > 0")
        .select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), F.explode("wids").alias("wid"))
        .join(owners, "wid")
        .groupBy("_id", "_key")
        .agg(F.collect_set("item_id").alias("items"))
    )
    whole = found.join(listed, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left")
    none = F.array().cast(listed.schema["items"].dataType)
    by_text = F.transform(F.array_sort(F.transform("items", lambda i: F.struct(i.cast("string").alias("s"), i.alias("i")))), lambda x: x["i"])
    return whole.select("doc_id", "key", "n_words", "n_hit", F.coalesce(by_text, none).alias("items"))


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no window of any item.

    Null and empty texts are kept. See find_items for windows and words.
    """
    dirty = find_items(docs, items, window).where("n_hit > 0").select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).distinct()
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_doc"), text_key().alias("_text"))
    kept = rows.join(dirty, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_key")), "left_anti")
    return kept.select("_row.*")
