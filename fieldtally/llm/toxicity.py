"""Toxicity from class-conditional Kneser-Ney models."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .calibration import Logistic, fit_logistic, log_loss
from .common import discard, maybe_among, stored, text_or_empty, without
from .hashing import mixed, word_hashes
from .quality import fold

# Words that make up at least this share of all words are looked up in memory: at most 2 / SHARE words, and none of the
# others is a hot key of the join that looks those up. No result depends on it.
SHARE = 1 / (1 << 18)
# So many words with the most histories, about, are in memory when texts are scored; the rest are looked up by a join.
AT_HAND = 1 << 19
# A filter of words has this many bits a word, up to 16 MB in all; beyond that more words pass it in vain, and none is lost.
WORD_BITS, MOST_BITS = 16, 1 << 27
# Discounts to choose from, by the loss on the calibration fold.
DISCOUNTS = (0.75, 1.0, 2.0, 3.0, 4.0)
CALIBRATION_DOCUMENTS = 20_000
_COUNTS = ("toxic", "ordinary", "either")
_BEGUN = ("n array<int>, rare array<int>, sums array<double>, mosts array<double>, "
          "words array<bigint>, at array<int>, beside array<int>, joined array<boolean>")
# Texts are looked up together until this many words have to be; a thousand texts are together in any case.
MOST_TOGETHER = 1 << 19
# Pairs of history and word are made distinct together until there are this many, a thousand texts in any case.
MOST_PAIRS = 1 << 21


@dataclass(frozen=True)
class KneserNey:
    """What the class models need beside the stored counts of each word, for each discount."""

    discounts: tuple[float, ...]
    totals: tuple[float, float]  # histories of all words in the toxic and the ordinary class
    taken: np.ndarray  # classes x discounts: what is taken off in all
    either: float  # histories of both classes together
    vocabulary: int
    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # hashes of the frequent words, sorted
    # discounts x those words, then the ratio of a word without counts, then NaN for one whose counts are not at hand
    ratios: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    def log_ratios(self, toxic: np.ndarray, ordinary: np.ndarray, either: np.ndarray) -> np.ndarray:
        """Discounts x words, from the counts of each word; a word with no counts has the backoff of both classes."""
        shared = (either + 0.5) / (self.either + 0.5 * (self.vocabulary + 1))
        out = []
        for i, discount in enumerate(self.discounts):
            logs = []
            for c, total, taken in zip((toxic, ordinary), self.totals, self.taken[:, i]):
                rest = taken / total if total else 1.0
                logs.append(np.log((c - np.minimum(c, discount)) / max(1.0, total) + max(rest, 1e-9) * shared))
            out.append(logs[0] - logs[1])
        return np.stack(out)

    def only(self, i: int) -> KneserNey:
        """The model with its discount number `i` alone."""
        return replace(self, discounts=self.discounts[i:i + 1], taken=self.taken[:, i:i + 1], ratios=self.ratios[i:i + 1])


def _places(words: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Place of each word in the sorted `among`, or -1."""
    at = np.searchsorted(among, words)
    known = at < len(among)
    known[known] = among[at[known]] == words[known]
    return np.where(known, at, -1)


def continuation_counts(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """Distinct histories of each word by class: word (its hash), toxic, ordinary, either; from `docs(text, y)`.

    A history is the word before (or the start of the text). Every task reduces its texts to distinct pairs
    of history and word, listed by word, before anything is shuffled; pairs are dealt by word, those of frequent words
    in 16 parts, and then counted.
    """
    def some(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        words, offsets = word_hashes(batch.column("text"))
        before = np.concatenate([np.zeros(1, np.uint64), words[:-1]])[:len(words)]
        before[offsets[:-1][np.diff(offsets) > 0]] = 0
        y = np.repeat(batch.column("y").to_numpy(zero_copy_only=False).astype(np.uint64), np.diff(offsets))
        # the class in the lowest bit, so that one sort makes the pairs distinct by class
        keyed, first = np.unique((mixed(before * np.uint64(3) + words) & ~np.uint64(1)) | y, return_index=True)
        return keyed, words[first]

    def listed(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        keyed, words = (np.concatenate(p) for p in zip(*parts))
        parts.clear()
        keyed, first = np.unique(keyed, return_index=True)
        words = words[first]
        part = np.where(_places(words, frequent) >= 0, (keyed >> np.uint64(1)) % np.uint64(16), 0).astype(np.int32)
        order = np.lexsort((part, words))
        keyed, words, part = keyed[order], words[order], part[order]
        starts = np.flatnonzero(np.r_[True, (words[1:] != words[:-1]) | (part[1:] != part[:-1])][:len(words)])
        lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(words)).astype(np.int32)), pa.array(keyed.view(np.int64)))
        return pa.RecordBatch.from_arrays([pa.array(words[starts].view(np.int64)), pa.array(part[starts]), lists],
                                          names=["word", "part", "pairs"])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for at in range(0, batch.num_rows, 1000):
                parts.append(some(batch.slice(at, 1000)))
                if sum(len(p[0]) for p in parts) >= MOST_PAIRS or at + 1000 >= batch.num_rows:
                    yield listed(parts)

    found = docs.select("text", "y").mapInArrow(pairs, "word long, part int, pairs array<bigint>").repartition("word", "part")
    each = found.select("word", "part", F.explode("pairs").alias("keyed"))
    bit = F.when(F.col("keyed").bitwiseAND(F.lit(1)) == 1, 1).otherwise(2)
    distinct = each.groupBy("word", "part", F.col("keyed").bitwiseAND(F.lit(-2)).alias("pair")).agg(F.bit_or(bit).alias("c"))
    in_class = [F.sum((F.col("c").bitwiseAND(b) > 0).cast("long")).alias(n) for b, n in ((1, "toxic"), (2, "ordinary"))]
    parts = distinct.groupBy("word", "part").agg(*in_class, F.count("*").alias("either"))
    return parts.groupBy("word").agg(*[F.sum(c).alias(c) for c in ("toxic", "ordinary", "either")])


def frequent_words(texts: DataFrame) -> np.ndarray:
    """Sorted hashes of all words with a share of SHARE or more in `texts(text)`, and of none below half of that.

    Each batch reports words with half that share of its own words or more: what it leaves out is less than half the
    share in all, so that half the share of the reported counts takes in every frequent word.
    """
    half = SHARE / 2

    def uses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            parts = [np.unique(word_hashes(texts.slice(at, 1000))[0], return_counts=True) for at in range(0, max(1, len(texts)), 1000)]
            words, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            n = np.zeros(len(words), np.int64)
            np.add.at(n, place, np.concatenate([p[1] for p in parts]))
            total = n.sum()
            often = n >= total * half
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(words[often].view(np.int64), 0)), pa.array(np.append(n[often], 0)),
                 pa.array(np.append(np.zeros(often.sum(), np.int64), total))], names=["word", "n", "total"])

    used = stored(texts.select("text").mapInArrow(uses, "word long, n long, total long").groupBy("word").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total")), "word-uses")
    total = used.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    often = used.filter((F.col("n") > 0) & (F.col("n") >= total * half)).select("word").toArrow()  # at most 2 / SHARE
    discard(used)
    return np.sort(often.column("word").to_numpy().view(np.uint64))


def kneser_ney(counts: DataFrame, words: np.ndarray) -> KneserNey:
    """The two class models from the stored continuation counts of all labelled texts; `words` are the frequent ones.

    In each class a word has its number of distinct histories less a discount; what is taken off goes to the
    shared backoff model, the histories of both classes together. A word that a few copied texts repeat has one
    history only and says nothing about its class, however often it occurs.
    """
    classes = ("toxic", "ordinary")
    sums = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("double") for c in (*classes, "either")], F.count("*"),
                      *[F.coalesce(F.sum(F.least(F.col(c), F.lit(d))), F.lit(0.0)) for c in classes for d in DISCOUNTS]).first()
    model = KneserNey(DISCOUNTS, (sums[0], sums[1]), np.array(sums[4:], dtype=float).reshape(2, -1), sums[2], sums[3])

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_places(batch.column("word").to_numpy().view(np.uint64), words) >= 0))

    table = counts.mapInArrow(known, counts.schema).toArrow()  # at most as many rows as frequent words
    at = np.searchsorted(words, table.column("word").to_numpy().view(np.uint64))
    toxic, ordinary, either = (np.zeros(len(words)) for _ in range(3))
    for name, array in (("toxic", toxic), ("ordinary", ordinary), ("either", either)):
        array[at] = table.column(name).to_numpy()
    ratios = model.log_ratios(toxic, ordinary, either)
    unseen = model.log_ratios(np.zeros(1), np.zeros(1), np.zeros(1))
    return replace(model, words=words, ratios=np.column_stack([ratios, unseen, np.full(len(ratios), np.nan)]))


def telling(counts: DataFrame, model: KneserNey) -> DataFrame:
    """The words of `counts` whose ratio differs from that of a word without counts, under a model of one discount.

    Where neither class has more histories of a word than the discount takes off, only the backoff is left in both
    classes; it cancels, and the ratio is that of any such word.
    """
    return counts.filter(F.greatest("toxic", "ordinary") > F.lit(model.discounts[0]))


def at_hand(counts: DataFrame, model: KneserNey) -> tuple[KneserNey, DataFrame]:
    """A model of one discount with the ratios of the words of most histories in memory too, and the counts of all other words.

    About AT_HAND words of `counts` are taken into memory, whatever the corpus: all of them if they are no more, else those with more
    histories than a quantile. What is left are the rarest words, which few texts hold, so that what has to be looked up
    by a join is a small share of the words of a corpus, and a smaller one the longer its words' tail.
    """
    n = counts.count()
    least = counts.agg(F.percentile_approx("either", 1 - AT_HAND / n, 10_000)).first()[0] if n > AT_HAND else 0
    table = counts.filter(F.col("either") > least).toArrow()  # AT_HAND rows and the error of the quantile, n / 10,000, at most
    ratios = model.log_ratios(*[table.column(c).to_numpy().astype(float) for c in _COUNTS])
    words, first = np.unique(np.concatenate([model.words, table.column("word").to_numpy().view(np.uint64)]), return_index=True)
    ratios = np.concatenate([model.ratios[:, :-2], ratios], axis=1)[:, first]
    return replace(model, words=words, ratios=np.column_stack([ratios, model.ratios[:, -2:]])), counts.filter(F.col("either") <= least)


def word_filter(words: DataFrame) -> np.ndarray:
    """A bitmap (as bytes; a power of two of bits) that holds the hash of every row of `words(word)`, sized by their number."""
    n = words.count()
    bits = min(MOST_BITS, max(1 << 15, 1 << (n * WORD_BITS).bit_length()))
    bit = F.col("word").bitwiseAND(F.lit(bits - 1)) + 1  # Spark's bitmaps begin at 1
    parts = words.groupBy(F.bitmap_bucket_number(bit).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).toArrow()  # at most MOST_BITS in all
    out = np.zeros((bits >> 15) * 4096, np.uint8)
    for bucket, part in zip(parts.column("bucket").to_pylist(), parts.column("bits").to_pylist()):
        out[(bucket - 1) * 4096:bucket * 4096] = np.frombuffer(part, np.uint8)
    return out


def _may_hold(bitmap: np.ndarray, words: np.ndarray) -> np.ndarray:
    bit = words & np.uint64(8 * len(bitmap) - 1)
    return bitmap[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1 == 1


def _begun(texts: pa.Array, model: KneserNey, bitmap: np.ndarray | None) -> dict[str, np.ndarray]:
    """What the words of every text give whose ratio is at hand, and the other words with what stands beside them.

    At hand are the ratios of the model's words and, given the `bitmap` of all other telling words, of words outside it. For each of
    the other words: `beside`, for each discount the place in `model.ratios` of the greater ratio next to it, and `joined`, whether
    the word before it is another such word of the same text.
    """
    words, offsets = word_hashes(texts)
    n = np.diff(offsets)
    begin, end = offsets[:-1], offsets[1:]
    at = _places(words, model.words)
    if bitmap is not None:
        at[(at < 0) & ~_may_hold(bitmap, words)] = -2
    known = at != -1
    rare = ~known
    before, after, joined = np.full(len(at), -1), np.full(len(at), -1), np.zeros(len(at), bool)
    before[1:], after[:-1], joined[1:] = at[:-1], at[1:], rare[:-1]
    before[begin[n > 0]] = -1
    after[end[n > 0] - 1] = -1
    joined[begin[n > 0]] = False
    sums, mosts = np.zeros((len(n), len(model.discounts))), np.full((len(n), len(model.discounts)), -np.inf)
    beside = np.empty((int(rare.sum()), len(model.discounts)), np.int32)
    for j, ratio in enumerate(model.ratios):
        value = ratio[at]
        total = np.concatenate([[0.0], np.cumsum(np.where(known, value, 0.0))])
        sums[:, j] = total[end] - total[begin]
        two = (value[:-1] + value[1:]) / 2
        for i in np.flatnonzero(n > 1):
            mosts[i, j] = np.fmax.reduce(two[begin[i]:end[i] - 1], initial=-np.inf)
        left, right = ratio[before[rare]], ratio[after[rare]]
        beside[:, j] = np.where((right > left) | np.isnan(left), after[rare], before[rare])
    upto = np.concatenate([[0], np.cumsum(rare)])[offsets]
    return {"n": n.astype(np.int32), "rare": np.diff(upto).astype(np.int32), "sums": sums.ravel(), "mosts": mosts.ravel(),
            "words": words[rare], "beside": beside.ravel(), "joined": joined[rare]}


def _measures(batch: pa.RecordBatch, model: KneserNey) -> np.ndarray:
    """Texts x discounts x measures: log-likelihood ratio by length, by its root, its greatest mean over two words
    in a row (one, if there is no other), and log length. Texts are those of all rows in order."""
    k = len(model.discounts)
    n, rare, at, beside, joined = (batch.column(c).flatten().to_numpy(zero_copy_only=False)
                                   for c in ("n", "rare", "at", "beside", "joined"))
    sums, mosts = (batch.column(c).flatten().to_numpy().reshape(-1, k).copy() for c in ("sums", "mosts"))
    distinct = batch.column("distinct").to_numpy().astype(np.int64)
    base = np.cumsum(distinct) - distinct
    # a word without counts has the ratio of an unseen one
    ratios = np.repeat(model.ratios[:, -2:-1], distinct.sum(), axis=1)
    found = batch.column("found").flatten()
    place = np.repeat(base, batch.column("found").value_lengths().to_numpy()) + found.field("place").to_numpy()
    for j in range(k):
        ratios[j, place] = found.field(f"r{j}").to_numpy()
    owner = np.repeat(np.arange(len(n)), rare)
    value = ratios[:, np.repeat(base, batch.column("at").value_lengths().to_numpy()) + at].T
    np.add.at(sums, owner, value)
    next_to = np.stack([ratio[b] for ratio, b in zip(model.ratios, beside.reshape(-1, k).T)], axis=1)
    np.fmax.at(mosts, owner, (value + next_to) / 2)
    both = np.flatnonzero(joined)
    np.fmax.at(mosts, owner[both], (value[both - 1] + value[both]) / 2)
    mosts[n == 1] = sums[n == 1]
    n = np.where(n > 0, n, np.nan)[:, None]
    return np.stack([sums / n, sums / np.sqrt(n), np.where(n > 0, mosts, np.nan), np.broadcast_to(np.log(n), sums.shape)], axis=2)


def _measured(table: DataFrame, counts: DataFrame, model: KneserNey, name: str, bitmap: np.ndarray | None = None) -> DataFrame:
    """`table` with the columns that `_measures` needs in place of `text`; a row holds several rows of it, in lists.

    Each text is reduced to the sums of the words whose ratio is at hand before anything is shuffled (see `_begun`). Every
    other word is listed once for all texts of a row; it meets its ratio by a join, and only place and ratio go
    back to the row. A word without counts is not found and has the ratio of the backoff.
    """
    kept = [c for c in table.columns if c != "text"]
    names = [*kept, "n", "rare", "sums", "mosts", "words", "at", "beside", "joined"]
    found_in = [f"r{j}" for j in range(len(model.discounts))]

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(rows: pa.RecordBatch, parts: list[dict[str, np.ndarray]]) -> pa.RecordBatch:
            whole = {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}
            words, at = np.unique(whole.pop("words"), return_inverse=True)
            whole |= {"words": words.view(np.int64), "at": at.astype(np.int32)}
            values = [*[rows.column(c) for c in kept], *[pa.array(whole[c]) for c in names[len(kept):]]]
            return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in values],
                                              names=names)

        for batch in batches:
            first, parts = 0, []
            for at in range(0, batch.num_rows, 1000):
                parts.append(_begun(batch.column("text").slice(at, 1000), model, bitmap))
                if sum(len(p["words"]) for p in parts) >= MOST_TOGETHER or at + 1000 >= batch.num_rows:
                    yield one(batch.slice(first, at + 1000 - first), parts)
                    first, parts = at + 1000, []

    light = replace(model, words=np.zeros(0, np.uint64), ratios=np.zeros((0, 0)))

    def ratio(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = light.log_ratios(*[batch.column(c).to_numpy().astype(float) for c in _COUNTS])
            yield pa.RecordBatch.from_arrays([batch.column("word"), *[pa.array(v) for v in values]], names=["word", *found_in])

    schema = "".join(f"`{c}` array<{table.schema[c].dataType.simpleString()}>, " for c in kept)
    begun = stored(table.mapInArrow(begin, schema + _BEGUN).withColumn("chunk", F.monotonically_increasing_id()), name)
    ratios = counts.select("word", *_COUNTS).mapInArrow(ratio, "word long, " + ", ".join(f"{c} double" for c in found_in))
    rare = begun.select("chunk", F.posexplode("words").alias("place", "word")).join(ratios, "word")
    found = rare.select("chunk", "place", *found_in).repartition("chunk").groupBy("chunk").agg(
        F.collect_list(F.struct("place", *found_in)).alias("found"))
    none = F.array().cast(found.schema["found"].dataType)
    return begun.withColumn("distinct", F.size("words")).join(found, "chunk", "left").select(
        *[c for c in names if c != "words"], "distinct", F.coalesce("found", none).alias("found"))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> tuple[DataFrame, KneserNey, Logistic]:
    """Stored continuation counts of every learned word, the models and the calibration, from labelled rows outside fold 0.

    The models count all labelled texts of folds 2 to 4; fold 1 chooses the discount and calibrates (at most
    CALIBRATION_DOCUMENTS labels, by a hash of the id). Null labels are left out.
    """
    known = labels.filter(F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    known = known.withColumn("fold", fold(F.col("doc_id")))
    texts = docs.select("doc_id", text_or_empty().alias("text"))
    learned = known.filter("fold > 1")
    # the labels grow with the corpus: only documents that may have one are shuffled to meet them
    rows = maybe_among(texts, F.xxhash64("doc_id"), learned, F.xxhash64("doc_id")).join(learned, "doc_id")
    frequent = frequent_words(texts)
    counts = stored(continuation_counts(rows, frequent), "continuation-counts")
    model = kneser_ney(counts, frequent)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _measures(batch, model).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([batch.column("y").flatten(), *[pa.array(c) for c in m.T]], names=["y", *names])

    names = [f"m{i}_{j}" for i in range(len(DISCOUNTS)) for j in range(4)]
    chosen = known.filter("fold = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(CALIBRATION_DOCUMENTS)
    held = texts.join(F.broadcast(chosen), "doc_id").select("y", "text")  # a bounded number of labels
    table: pd.DataFrame = _measured(held, counts, model, "calibration-words").mapInArrow(
        measure, "y int, " + ", ".join(f"{n} double" for n in names)).toPandas().dropna()
    y = table["y"].to_numpy(dtype=float)
    best = None
    for i in range(len(DISCOUNTS)):
        m = table[[f"m{i}_{j}" for j in range(4)]].to_numpy(dtype=float)
        fitted = fit_logistic(m, y)
        loss = log_loss(y, fitted.scores(m))
        if best is None or loss < best[0]:
            best = (loss, model.only(i), fitted)
    return counts, best[1], best[2]


def score(docs: DataFrame, labels: DataFrame, label: str = "toxic", cut: float = 0.5) -> DataFrame:
    """Toxicity of every whole text: doc_id, held_out, score, predicted.

    The score is a calibrated function of length-normalised log-likelihood ratios of the toxic and the ordinary
    model: over the whole text and over the words in a row where it is highest. Every word has counts of its own, and
    one that no learned text holds gets the backoff. An empty or null text gets the share
    of label 1. `predicted` is 1 from `cut` on. One row per row of `docs`, repeated rows too; without labels of either kind
    the scores say nothing but stay between 0 and 1; an empty table gives an empty table; further columns are left out.
    """
    return _scored(docs.select("doc_id", text_or_empty().alias("text")), labels, label).select(
        "doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def _scored(table: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """`table(doc_id, text)` with `score` in place of `text`; other columns stay."""
    counts, model, logistic = train(table, labels, label)
    model, counts = at_hand(telling(counts, model), model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array(logistic.scores(_measures(batch, model)[:, 0]))
            yield pa.RecordBatch.from_arrays([*[batch.column(c).flatten() for c in kept], scores], names=[*kept, "score"])

    kept = [c for c in table.columns if c != "text"]
    schema = "".join(f"`{c}` {table.schema[c].dataType.simpleString()}, " for c in kept)
    return _measured(table, counts, model, "text-words", word_filter(counts)).mapInArrow(judge, schema + "score double")


def without_toxic(docs: DataFrame, labels: DataFrame, label: str = "toxic", cut: float = 0.5) -> DataFrame:
    """The rows of `docs` that score below `cut`; columns as they were."""
    text = text_or_empty()
    scored = _scored(docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("text_hash")), labels, label)
    return without(docs, stored(scored.filter(F.col("score") >= cut).select("doc_id", "text_hash").distinct(), "toxic-rows"))
