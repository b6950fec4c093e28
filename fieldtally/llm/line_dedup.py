"""Line dedup by a deletion-neighbourhood join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, text_or_empty, words_of

# Lines of fewer words are compared exactly: one changed word of a few is another line.
MIN_WORDS = 8


def _end_lengths(n: Column) -> Column:
    """How many words at either end of a line of `n` words one edit must leave alone.

    A fixed length up to the next power of two: half the power below, so that the two ends
    never overlap. A line of exactly a power of two words also takes the length of lines
    one word shorter, as an edit may lead there.
    """
    power = F.length(F.bin(n)) - 1  # the position of the highest bit
    own = F.pow(F.lit(2.0), power - 1).cast("int")
    exact = F.bit_count(n) == 1
    return F.when(exact, F.array(own, (own / 2).cast("int"))).otherwise(F.array(own))


def _ends(words: Column, n: Column) -> Column:
    """Hashes of both ends of a line: any line within one edit shares one of them."""
    return F.flatten(F.transform(_end_lengths(n), lambda k: F.array(
        F.xxhash64(F.lit("head"), k, F.slice(words, F.lit(1), k)),
        F.xxhash64(F.lit("tail"), k, F.slice(words, n - k + 1, k)))))


def _within_one_edit(a: Column, b: Column) -> Column:
    """Whether two word lists are equal but for one word changed, added or removed."""
    def shared(x: Column, y: Column) -> Column:
        same = F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False)))
        stop = F.array_position(same, False)
        return F.when(stop > 0, stop - 1).otherwise(F.least(F.size(x), F.size(y)))

    longer = F.greatest(F.size(a), F.size(b))
    return (F.abs(F.size(a) - F.size(b)) <= 1) & (shared(a, b) + shared(F.reverse(a), F.reverse(b)) >= longer - 1)


def _lines(docs: DataFrame) -> DataFrame:
    text = text_or_empty()
    lines = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), F.posexplode(F.split(text, "\n", -1))
                        .alias("line_no", "line"))
    return lines.select("doc_id", "text_hash", "line_no", words_of(F.col("line")).alias("words"))


def line_verdicts(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Every line with words: doc_id, text_hash, line_no, exact, near.

    `exact` says that the same words stand in an earlier line, `near` that an earlier line
    has them but for one word changed, added or removed. Earlier means by doc_id (null
    first), text hash and line number; the earliest line of each kind is kept. A word is a
    run of anything but blanks; the bound of one edit holds where both lines have at least
    `min_words` words. Blank lines never count. Null texts are empty. Repeated rows (equal id
    and text) are one document and do not repeat each other's lines. An empty table gives an
    empty table; further columns are left out.

    Equal lines are reduced to their first place before anything else. Of the distinct lines
    only those that share their head or tail with another one can have a neighbour; these
    emit one key for each word left out, together with its place, and one for the whole line.
    Lines with the same key and place differ in that word at most, so that each need only meet
    the earliest of them; a whole line that equals a shortened one meets it directly. Every
    such pair is verified on the words.
    """
    n = F.size("words")
    parsed = _lines(docs).filter(n > 0).select(
        "doc_id", "text_hash", "line_no", F.unhex(F.md5(F.array_join("words", " "))).alias("line"),
        F.when(n >= min_words, _ends(F.col("words"), n)).alias("ends"))
    lines = stored(parsed, "lines")
    place = F.struct("doc_id", "text_hash", "line_no")
    firsts = stored(lines.groupBy("line").agg(F.min(place).alias("place"), F.first("ends").alias("ends")), "first-lines")

    ends = firsts.select("line", F.explode("ends").alias("end"))
    shared = ends.groupBy("end").agg(F.count_distinct("line").alias("n")).filter("n > 1")
    suspects = ends.join(shared, "end", "left_semi").select("line").distinct().join(firsts.select("line", "place"), "line")
    # all suspect lines of one document in one row, which its own lines bound
    per_doc = suspects.groupBy(F.col("place.doc_id").alias("d"), F.col("place.text_hash").alias("h")).agg(
        F.collect_list("place.line_no").alias("wanted"))
    text = text_or_empty()
    texts = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("text_hash")).join(
        per_doc, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")))
    wanted = texts.select("doc_id", "text_hash", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "raw"),
                          "wanted").filter(F.array_contains("wanted", F.col("line_no")))
    found = stored(wanted.select(place.alias("place"), words_of(F.col("raw")).alias("words"))
                   .select("place", "words", F.unhex(F.md5(F.array_join("words", " "))).alias("line"))
                   .dropDuplicates(["line"]), "near-lines")
    # numbers in the order of places: what is shuffled from here on are whole numbers only
    wanted = stored(found.repartitionByRange("place").sortWithinPartitions("place").select(
        "line", "words", F.monotonically_increasing_id().alias("id")), "numbered-lines")

    hashed = wanted.select("id", F.transform("words", lambda w: F.xxhash64(w)).alias("codes"))
    keys = hashed.select("id", "codes", F.explode(F.sequence(F.lit(0), F.size("codes") - 1)).alias("at"))
    keys = keys.select("id", "at", F.xxhash64(F.slice("codes", F.lit(1), F.col("at")), F.slice(
        "codes", F.col("at") + 2, F.size("codes"))).alias("key"))
    whole = hashed.select(F.xxhash64("codes", F.slice("codes", 1, 0)).alias("key"), F.lit(-1).alias("gap"),
                          F.col("id").alias("other"))
    earliest = keys.groupBy("key", F.col("at").alias("gap")).agg(F.min("id").alias("other"), F.count("*").alias("n"))
    # keys and word lists are many times the files they come from, which Spark's estimate goes by: never broadcast
    met = keys.hint("merge").join(earliest.filter("n > 1").drop("n").unionByName(whole), "key").filter(
        ((F.col("gap") < 0) | (F.col("gap") - F.col("at") == 0)) & (F.col("id") != F.col("other")))
    pairs = met.select(F.greatest("id", "other").alias("id"), F.least("id", "other").alias("other")).distinct()
    a = wanted.select("id", "line", F.col("words").alias("a"))
    b = wanted.select(F.col("id").alias("other"), F.col("words").alias("b"))
    near = pairs.join(a.hint("merge"), "id").join(b.hint("merge"), "other").filter(_within_one_edit(F.col("a"), F.col("b")))
    near = near.select(F.col("line").alias("near_line")).distinct()

    judged = lines.join(firsts.select("line", F.col("place").alias("first_place")), "line").join(
        near, F.col("line") == F.col("near_line"), "left")
    return judged.select("doc_id", "text_hash", "line_no", (place != F.col("first_place")).alias("exact"),
                         F.col("near_line").isNotNull().alias("near"))


def line_report(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Per document (by id and text): doc_id, n_lines, n_exact, n_near, dropped (line numbers, comma-joined).

    n_near counts dropped lines that are no exact repeats. See `line_verdicts`.
    """
    text = text_or_empty()
    sizes = docs.select("doc_id", F.xxhash64(text).alias("text_hash"),
                        F.size(F.split(text, "\n", -1)).cast("long").alias("n_lines")).distinct()
    verdicts = line_verdicts(docs, min_words).filter("exact or near").groupBy("doc_id", "text_hash").agg(
        F.sum(F.col("exact").cast("long")).alias("n_exact"),
        F.sum((~F.col("exact")).cast("long")).alias("n_near"),
        F.array_join(F.array_sort(F.collect_list("line_no")), ",").alias("dropped"))
    verdicts = verdicts.withColumnsRenamed({"doc_id": "d", "text_hash": "h"})
    return sizes.join(verdicts, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left").select(
        "doc_id", "n_lines", F.coalesce("n_exact", F.lit(0)).alias("n_exact"),
        F.coalesce("n_near", F.lit(0)).alias("n_near"), F.coalesce("dropped", F.lit("")).alias("dropped"))


def without_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """`docs` with the dropped lines cut out of `text`; every row and all other columns stay."""
    gone = line_verdicts(docs, min_words).filter("exact or near").groupBy(
        F.col("doc_id").alias("__line_id"), F.col("text_hash").alias("__line_hash")).agg(
        F.collect_set("line_no").alias("__line_gone"))
    joined = docs.join(gone, F.col("doc_id").eqNullSafe(F.col("__line_id")) &
                       (F.xxhash64(text_or_empty()) == F.col("__line_hash")), "left")
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains("__line_gone", i)), "\n")
    return joined.withColumn("text", F.when(F.col("__line_gone").isNull(), F.col("text")).otherwise(kept)).select(
        *docs.columns)
