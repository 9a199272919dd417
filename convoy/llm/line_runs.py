"""Line dedup: repeated runs of whole lines, found by prefix doubling over sequences of line ids.

Every document is a sequence of line ids. Doubling gives each position the name of the 2, 4, 8, ...
lines that begin there, from the names of the halves; two overlapping names make the name of a run of
any length. Positions whose suffixes share a run lie in one interval of the suffix array; all that
is needed of it is its first position in document order, which an aggregate by the run's name gives
without sorting the intervals themselves. Runs of fewer than ``min_words`` words are no copies; a
longer repeated run is the union of the shortest sufficient runs that begin and end on its lines,
so only those are named. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from convoy.llm.common import text_key

#: Words that a repeated run needs to count as a copy.
MIN_WORDS = 50


def _pair(a: Column, b: Column, salt: int) -> Column:
    return F.xxhash64(F.lit(salt), a, b)


def numbered_lines(docs: DataFrame) -> DataFrame:
    """One row per line: document, position, two 64-bit ids of the line, number of words."""
    lines = docs.select("doc_id", text_key().alias("key"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    # white space at either end leaves an empty part
    words = F.size(F.array_remove(F.split("line", r"[ \t\r\f\x0B]+"), ""))
    return lines.select(
        "doc_id", "key", "pos", F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b"), words.alias("words")
    )


def sufficient_runs(lines: DataFrame, min_words: int) -> DataFrame:
    """The shortest runs of at least ``min_words`` words from each line on and up to each line.

    Returns document, first and last position, and the run's name (two 64-bit values).
    """
    # rows equal in doc_id and text are one document
    rows = lines.repartition("doc_id", "key").dropDuplicates(["doc_id", "key", "pos"])
    # here and not where words are counted: Spark would count them once for the filter and once more for the column
    rows = rows.where("words > 0")
    doc = Window.partitionBy("doc_id", "key")
    by_pos = doc.orderBy("pos")
    rows = rows.withColumn("stop", F.sum("words").over(by_pos.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("start", F.col("stop") - F.col("words"))
    # a line has a word at least, so a run has min_words lines at most: levels up to that power of two
    levels = max(min_words - 1, 0).bit_length()
    for side in ("a", "b"):
        rows = rows.withColumnRenamed(side, f"{side}0")
    for k in range(1, levels):
        half = 1 << (k - 1)
        rows = rows.withColumns(
            {f"{side}{k}": _pair(F.col(f"{side}{k - 1}"), F.lead(f"{side}{k - 1}", half).over(by_pos), k) for side in ("a", "b")}
        )
    # the name of the 2^k lines that end here
    names = [f"{side}{k}" for k in range(levels) for side in ("a", "b")]
    ends = {f"{n}_end": F.lag(n, (1 << int(n[1:])) - 1).over(by_pos) if n[1:] != "0" else F.col(n) for n in names}
    rows = rows.withColumns(ends)
    ahead = doc.orderBy("start").rangeBetween(0, min_words - 1)
    back = doc.orderBy("stop").rangeBetween(1 - min_words, 0)
    own = F.struct("pos", "stop", *names)
    tail = F.struct("pos", "stop", *[f"{n}_end" for n in names])
    # both runs of a line in one reading: from it on, and up to it
    rows = rows.select(
        "doc_id", "key", "start", "stop", own.alias("own"), tail.alias("tail"),
        F.last(tail).over(ahead).alias("last"), F.count("*").over(ahead).alias("n_ahead"),
        F.first(own).over(back).alias("first"), F.count("*").over(back).alias("n_back"),
    )

    def run(first: str, last: str, n: str, enough: Column) -> Column:
        def name(side: str) -> Column:
            out = F.lit(None).cast("long")
            for k in range(levels):
                both = _pair(F.col(f"{first}.{side}{k}"), F.col(f"{last}.{side}{k}_end"), 100)
                out = F.when(F.col(n).between(1 << k, (2 << k) - 1), both).otherwise(out)
            return F.xxhash64(n, out)

        named = F.struct(
            F.col(f"{first}.pos").alias("first_pos"), F.col(f"{last}.pos").alias("last_pos"), name("a").alias("name_a"), name("b").alias("name_b")
        )
        return F.when(enough, named)

    forward = run("own", "last", "n_ahead", F.col("last.stop") - F.col("start") >= min_words)
    # a line that is enough by itself is a forward run already
    backward = run("first", "tail", "n_back", (F.col("stop") >= min_words) & (F.col("n_back") > 1))
    return rows.select("doc_id", "key", F.explode(F.array_compact(F.array(forward, backward))).alias("run")).select("doc_id", "key", "run.*")


def later_copies(runs: DataFrame) -> DataFrame:
    """Runs whose name occurs at an earlier place (document, then position): those to be deleted."""
    place = F.struct("doc_id", "key", "first_pos")
    firsts = (
        runs.groupBy("name_a", "name_b")
        .agg(F.min(place).alias("origin"), F.max(place).alias("latest"))
        .where("origin != latest")
        .select("name_a", "name_b", "origin")
    )
    return runs.join(firsts, ["name_a", "name_b"]).where(~place.eqNullSafe(F.col("origin"))).drop("origin")


def drop_repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with later copies of repeated line runs cut from ``text``; all other columns as they were.

    A line, with blank lines inside the run, goes if it lies in a run of neighbouring lines, equal
    character by character and with ``min_words`` words or more, that also occurs at an earlier place: in a
    document with a smaller doc_id (null first), or further up in the same one. Documents of one
    doc_id and different texts are ordered by a hash of the text; rows equal in both are one document and
    get the same result. Blank lines (ASCII white space only) do not part neighbours. Adds
    n_lines (lines of the input text; 0 for null) and n_removed (long). A null text stays null, an
    empty one is one blank line; a document that is a copy as a whole keeps an empty text. Input
    columns named like an added one are replaced.
    """
    copies = later_copies(sufficient_runs(numbered_lines(docs), min_words))
    removed = copies.groupBy(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).agg(
        F.collect_set(F.struct("first_pos", "last_pos")).alias("_runs")
    )
    removed = removed.withColumn("_gone", F.array_distinct(F.flatten(F.transform("_runs", lambda r: F.sequence(r.first_pos, r.last_pos)))))
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_doc"), text_key().alias("_text"))
    joined = rows.join(removed, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_key")), "left")
    lines = F.split("_row.text", "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_gone"))
    text = F.when(F.col("_gone").isNull(), F.col("_row.text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
    added = {
        "n_lines": F.when(F.col("_row.text").isNull(), 0).otherwise(F.size(lines)).cast("long"),
        "n_removed": F.coalesce(F.size("_gone"), F.lit(0)).cast("long"),
    }
    same = [text.alias(c) if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c not in added]
    return joined.select(*same, *(c.alias(n) for n, c in added.items()))
