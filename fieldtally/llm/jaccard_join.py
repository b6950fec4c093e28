"""N-gram Jaccard join with adaptive multi-match prefixes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.components import components
from .common import discard, maybe_among, maybe_marked, stored, text_or_empty
from .hashing import mixed, shingles, word_hashes

# Cells of the count sketch that finds frequent shingles (8 bytes each on the driver, 4 in a task), with half as many again
# for shingles that prefixes hardly reach, and the blocks they are sent in.
CELLS, BLOCKS = 1 << 21, 512
# Matches that may be asked of a prefix at most, and the cost of a verification in posting reads.
MOST_MATCHES, VERIFY_COST = 6, 8.0
# Cells whose odd counts tell apart sets that share most of a prefix (a multiple of 64).
ODD_BITS = 256
# Postings of a frequent shingle are dealt out to groups of about this many texts.
GROUP = 2000


# Texts whose words are in memory together.
TOGETHER = 500


def _sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    for at in range(0, len(texts), TOGETHER):
        words, offsets = word_hashes(texts.slice(at, TOGETHER))
        for a, b in zip(offsets[:-1], offsets[1:]):
            yield shingles(words[a:b], k)


def _cells(s: np.ndarray, cut: int, cells: int) -> np.ndarray:
    """The cell of each shingle: one of the first `cells` for hashes below `cut`, one of half as many more from there on."""
    return np.where(s < np.uint64(cut), s & np.uint64(cells - 1), np.uint64(cells) + (s & np.uint64(cells // 2 - 1))).astype(np.int64)


def _cut(num: int, den: int) -> int:
    """The hash below which nearly all shingles lie that a prefix takes: rare shingles are taken in order of their hashes."""
    return min(2**64 - 1, 2**64 * 5 * (den - num) // (4 * den))


def shingle_sketch(docs: DataFrame, k: int, cut: int) -> np.ndarray:
    """How many texts hold the shingles of each cell: a fixed number of cells, whatever the input.

    A task sends its counts as blocks of cells; blocks are dealt by number and added one after the other. Most of the cells
    are for the shingles below `cut`, which are the ones that a prefix may hold, so that few of them share a cell.
    """
    first, cells = CELLS, CELLS * 3 // 2
    block = cells // BLOCKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, dtype=np.uint32)
        for batch in batches:
            for s in _sets(batch.column(0), k):
                np.add.at(total, _cells(s, cut, first), np.uint32(1))
        if total.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(BLOCKS), pa.int32()), pa.array([total[i:i + block].tobytes() for i in range(0, cells, block)],
                                                               pa.binary())], names=["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None
        for batch in batches:
            for number, counts in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist()):
                if number != at:
                    if at is not None:
                        yield pa.RecordBatch.from_pylist([{"block": at, "counts": total.tobytes()}], schema=kind)
                    at, total = number, np.zeros(block, dtype=np.int64)
                total += np.frombuffer(counts, dtype=np.uint32)
        if at is not None:
            yield pa.RecordBatch.from_pylist([{"block": at, "counts": total.tobytes()}], schema=kind)

    kind = pa.schema([("block", pa.int32()), ("counts", pa.binary())])
    parts = docs.select(text_or_empty().alias("text")).mapInArrow(count, "block int, counts binary")
    sums = parts.repartition("block").sortWithinPartitions("block").mapInArrow(add, "block int, counts binary")
    sums = stored(sums, "shingle-sketch")
    sketch = np.zeros(cells, dtype=np.int64)
    for row in sums.collect():  # BLOCKS rows, 8 bytes a cell in all
        sketch[row["block"] * block:(row["block"] + 1) * block] = np.frombuffer(row["counts"], dtype=np.int64)
    discard(sums)
    return sketch.astype(np.float32)


def _prefixes(docs: DataFrame, k: int, num: int, den: int, sketch: np.ndarray) -> DataFrame:
    """One row per text: id, hash, size and signature of its set, matches asked for, rank, and prefix.

    Shingles are ordered from rare to frequent classes of the sketch, then by hash. A text
    of s shingles must share at least o = ceil(s * num / den) of them with any partner, so that l
    shared ones lie among its first s - o + l. The number l is the one of least estimated cost:
    postings read, and candidates (postings by matches asked) verified. Of two texts the
    smaller l counts. Equal sets in one task give one prefix. `odd` has a bit for each of ODD_BITS cells that holds an odd number
    of the shingles: two sets differ in as many shingles as in such bits, or in more.
    """
    cut = _cut(num, den)
    first, excess = len(sketch) * 2 // 3, sketch.copy()
    for part in (excess[:first], excess[first:]):
        mean = float(part.sum(dtype=np.float64)) / len(part)
        floor = 4 * math.sqrt(mean) + 4  # what stands out of the noise of a cell
        part -= mean
        part[part <= floor] = 1.0

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("n", "sig", "check", "matches", "rank", "prefix", "copies", "odd")}
            for s in _sets(batch.column("text"), k):
                n = len(s)
                sig = int(mixed(s).sum(dtype=np.uint64)) if n else 0
                check = int(np.bitwise_xor.reduce(mixed(s ^ np.uint64(0x5851F42D4C957F2D)))) if n else 0
                matches, rank, prefix, copies, odd = 0, 0.0, None, None, None
                if n and sig not in seen:
                    if len(seen) < 1_000_000:
                        seen.add(sig)
                    texts = excess[_cells(s, cut, first)]
                    level = np.floor(np.log2(texts)).astype(np.int64)
                    rank = float(level.mean())
                    order = np.lexsort((s, level)) if level.any() else np.arange(n)
                    need = -(-n * num // den)
                    most = min(MOST_MATCHES, need)
                    reads = np.cumsum(texts[order[:n - need + most]])
                    ls = np.arange(1, most + 1)
                    cost = reads[n - need + ls - 1] * (1 + VERIFY_COST / ls)
                    matches = int(ls[np.argmin(cost)])
                    chosen = order[:n - need + matches]
                    prefix = s[chosen].view(np.int64)
                    copies = np.ceil(texts[chosen] / GROUP).astype(np.int32)
                    cells = (mixed(s) & np.uint64(ODD_BITS - 1)).astype(np.int64)
                    odd = np.packbits(np.bincount(cells, minlength=ODD_BITS) & 1 == 1).view(np.int64)
                for name, value in (("n", n), ("sig", np.uint64(sig).astype(np.int64)),
                                    ("check", np.uint64(check).astype(np.int64)), ("matches", matches), ("rank", rank),
                                    ("prefix", prefix), ("copies", copies), ("odd", odd)):
                    out[name].append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(out["n"], pa.int64()),
                 pa.array(out["sig"], pa.int64()), pa.array(out["check"], pa.int64()),
                 pa.array(out["matches"], pa.int32()), pa.array(out["rank"], pa.float32()),
                 pa.array(out["prefix"], pa.list_(pa.int64())), pa.array(out["copies"], pa.list_(pa.int32())),
                 pa.array(out["odd"], pa.list_(pa.int64()))],
                names=["doc_id", "text_hash", "n", "sig", "check", "matches", "rank", "prefix", "copies", "odd"])

    text = text_or_empty()
    table = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"),
                        text.alias("text"))
    return stored(table.mapInArrow(rows, "doc_id long, text_hash long, n long, sig long, check long, matches int, "
                                         "rank float, prefix array<long>, copies array<int>, odd array<long>"), "prefixes")


def _verified(docs: DataFrame, reps: DataFrame, pairs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs(a, b) of set signatures whose sets are similar enough, by exact counting.

    Texts are fetched once per side of a pair and sorted so that the text `a` comes before all
    its partners: a task holds the set of one `a` at a time. Partners of a frequent `a` are dealt
    out to groups, each with a copy of `a`.
    """
    spread = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("groups"))
    dealt = pairs.join(spread, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("groups")).cast("int").alias("part"))
    left = spread.select("a", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("part"),
                         F.col("a").alias("sig"), F.lit(0).alias("side"))
    members = stored(left.unionByName(dealt.select("a", F.col("part"), F.col("b").alias("sig"), F.lit(1).alias("side"))),
                     "jaccard-pairs")
    needed = reps.join(members.select("sig").distinct(), "sig")
    text = text_or_empty()
    texts = docs.select(F.xxhash64(text).alias("text_hash"), text.alias("text"))
    texts = maybe_among(texts, F.col("text_hash"), needed, F.col("text_hash")).dropDuplicates(["text_hash"])
    sets = needed.select("sig", "text_hash").join(texts, "text_hash").select("sig", "text")
    grouped = members.join(sets, "sig").repartition("a", "part").sortWithinPartitions("a", "part", "side")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        key = None
        for batch in batches:
            found: tuple[list, list] = ([], [])
            columns = [batch.column(c).to_pylist() for c in ("a", "part", "sig", "side")]
            for a, part, sig, side, s in zip(*columns, _sets(batch.column("text"), k)):
                if (a, part) != key:
                    key, held = (a, part), []
                if side == 0:
                    held.append(s)
                    continue
                for t in held:
                    if min(len(s), len(t)) * den < max(len(s), len(t)) * num:
                        continue
                    both = len(np.intersect1d(s, t, assume_unique=True))
                    if den * both >= num * (len(s) + len(t) - both):
                        found[0].append(a)
                        found[1].append(sig)
                        break
            yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64())],
                                             names=["a", "b"])

    links = stored(grouped.select("a", "part", "sig", "side", "text").mapInArrow(check, "a long, b long").distinct(),
                   "jaccard-links")
    discard(members)
    return links


def _fits(n: Column, m: Column, num: int, den: int) -> Column:
    return F.least(n, m) * den >= F.greatest(n, m) * num


def _slack(n: str, m: str, num: int, den: int) -> tuple[Column, Column]:
    """How many shingles either of two sets may have besides those that a link needs them to share."""
    need = F.ceil((F.col(n) + F.col(m)) * num / (num + den))
    return F.col(n) - need, F.col(m) - need


def _size(info: str) -> Column:
    return F.shiftright(F.col(info), 8).bitwiseAND(F.lit(0xFFFFFFFF))


def _matches(info: str) -> Column:
    return F.col(info).bitwiseAND(F.lit(0xFF)).cast("int")


def similar_groups(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Groups of documents linked by similar shingle sets: doc_id, text_hash, n_shingles, component_id, group.

    `docs(doc_id, text)`. Words are lower-cased (A-Z) runs of anything but ASCII blanks; a set
    holds the distinct k-word shingles, or the whole sequence where there are fewer words. Two
    documents link when den * shared >= num * united; component_id is the smallest doc_id
    reachable. One row per row of `docs`; null and blank texts have empty sets, link with nothing and keep
    their own id; rows with equal sets (repeated rows too) are one text; null ids are passed
    over for component_id while the group has another id; an empty table gives an empty table; further columns are
    left out. `group` tells groups apart where ids are null; it is null for empty sets.

    Links are found in two steps that lose none. First every text is held against one text of
    its postings, the one that shares most of its prefix; that ties groups of near copies
    together with one link each. Then texts of different groups are held against each other if they share as many
    shingles as the lesser of the two asks for among those of the prefixes for their two sizes. The rarest of these has the others above
    above it in both texts, in the order of how many texts hold them, so that only shingles with so many above them pair texts up. A
    text pairs with none where too few shingles that another group holds lie in its prefix for that pair, as in near copies with
    more shingles of their own than a link leaves out, and two texts do not pair whose bits of odd counts differ in more places than
    linked sets do in shingles. Pairs within a group need no look.
    """
    sketch = shingle_sketch(docs, k, _cut(num, den))
    rows = _prefixes(docs, k, num, den, sketch)
    reps = rows.filter("prefix is not null").groupBy("sig").agg(
        F.min(F.struct("check", "text_hash")).alias("first")).select("sig", "first.text_hash")

    # rank, size and matches in one number, which orders by rank first
    info = F.shiftleft((F.col("rank") * 1000).cast("long"), 40).bitwiseOR(
        F.shiftleft(F.col("n"), 8)).bitwiseOR(F.col("matches"))
    posting = rows.filter("prefix is not null").select(
        "sig", info.alias("info"), F.posexplode(F.arrays_zip("prefix", "copies")).alias("at", "x")).select(
        F.col("x.prefix").alias("token"), "at", F.when(F.col("x.copies") > 1, F.pmod("sig", F.col("x.copies")))
        .otherwise(-1).cast("int").alias("part"), "sig", "info").repartition("token", "part")
    # one shuffle of the postings: the first text of a token, in each of its groups, comes from a window
    alike = W.partitionBy("token", "part")
    live = posting.select("*", F.max(F.struct("info", "sig")).over(alike).alias("head"), F.min("sig").over(alike).alias("low"),
                          F.max("sig").over(alike).alias("high"), F.count("*").over(alike).alias("texts"))
    live = stored(live.filter("low <> high or part >= 0").drop("low", "high"), "live-postings")
    dealt = live.filter("part >= 0")
    heads = dealt.groupBy("token", "part").agg(F.max("head").alias("head")).select(
        "token", "part", F.max("head").over(W.partitionBy("token")).alias("head"))  # a row per group of a token
    headed = live.filter("part < 0").unionByName(dealt.drop("head").join(heads, ["token", "part"]))

    stars = headed.filter((F.col("sig") != F.col("head.sig")) & _fits(_size("info"), _size("head.info"), num, den))
    stars = stars.groupBy("sig", F.col("head.sig").alias("head")).agg(
        F.count_distinct("token").alias("shared"), F.first(F.least(_matches("info"), _matches("head.info"))).alias("asked"),
        F.first("head.info").alias("info"))
    best = stars.filter("shared >= asked").groupBy("sig").agg(F.max(F.struct("shared", "info", "head")).alias("best"))
    best = stored(best.select(F.col("best.head").alias("a"), F.col("sig").alias("b")), "stars")
    first = _verified(docs, reps, best, k, num, den)
    group = stored(components(first.select(F.explode(F.array("a", "b")).alias("v")).distinct(), first, []), "groups")

    # tokens dealt to several groups are the most frequent ones, whatever their groups hold
    often = F.when(F.col("part") >= 0, F.lit(1 << 40)).otherwise(F.col("texts")).alias("texts")
    placed = live.select("token", "at", "sig", _size("info").alias("n"), _matches("info").alias("matches"), often).distinct().join(
        group.select(F.col("v").alias("sig"), "label"), "sig", "left").withColumn("label", F.coalesce("label", "sig"))
    mixed_tokens = placed.groupBy("token").agg(F.min("label").alias("a"), F.max("label").alias("b")).filter("a <> b")
    placed = placed.join(mixed_tokens.select("token"), "token", "left_semi")
    # how many tokens of a text that it may share with another group are more frequent than this one, and the places of the first ones:
    # a text with more other tokens before them than any link leaves out pairs with none
    own = W.partitionBy("sig")
    placed = placed.withColumn("above", F.row_number().over(own.orderBy(F.desc("texts"), F.desc("token"))) - 1).withColumn(
        "first", F.slice(F.sort_array(F.collect_list("at").over(own)), 1, MOST_MATCHES))
    placed = stored(placed.filter(F.get("first", F.lit(0)) <= F.col("n") - F.ceil(F.col("n") * num / den)), "open-postings")
    odds = rows.filter("prefix is not null").groupBy("sig").agg(F.first("odd").alias("odd"))
    # texts of the group that holds a token most often meet the texts of other groups, not one another
    lead = placed.groupBy("token", "label").agg(F.count("*").alias("held")).groupBy("token").agg(
        F.max(F.struct("held", "label")).alias("lead")).select("token", "lead.label").withColumnRenamed("label", "lead")
    led = placed.join(odds, "sig").join(lead, "token")
    x, y = led.filter("label <> lead").alias("x"), led.alias("y")
    slack_x, slack_y = _slack("x.n", "y.n", num, den)
    asked = F.least("x.matches", "y.matches")
    differ = sum((F.bit_count(F.get("x.odd", F.lit(i)).bitwiseXOR(F.get("y.odd", F.lit(i)))) for i in range(ODD_BITS // 64)), F.lit(0))
    cross = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.label") != F.col("y.label")) &
                   ((F.col("y.label") == F.col("y.lead")) | (F.col("x.sig") < F.col("y.sig"))) &
                   (F.col("x.at") < slack_x + asked) & (F.col("y.at") < slack_y + asked) &
                   (F.get("x.first", asked - 1) < slack_x + asked) & (F.get("y.first", asked - 1) < slack_y + asked) &
                   (F.least("x.above", "y.above") >= asked - 1) & (differ <= slack_x + slack_y))
    less = F.col("x.sig") < F.col("y.sig")
    candidates = stored(cross.select(
        F.least("x.sig", "y.sig").alias("a"), F.greatest("x.sig", "y.sig").alias("b"),
        F.when(less, F.col("x.n")).otherwise(F.col("y.n")).cast("int").alias("n_a"),
        F.when(less, F.col("y.n")).otherwise(F.col("x.n")).cast("int").alias("n_b")).distinct(), "candidates")
    met = candidates.select(F.explode(F.array("a", "b")).alias("sig"))
    own = maybe_among(rows.filter("prefix is not null").select("sig", "n", "matches", "prefix"), F.col("sig"), met,
                      F.col("sig")).dropDuplicates(["sig"])
    first_own, second_own = (own.select(F.col("sig").alias(c), F.struct("n", "matches", "prefix").alias(f"of_{c}"))
                             for c in "ab")
    slack_a, slack_b = _slack("n_a", "n_b", num, den)
    cross = candidates.join(first_own, "a").select("a", "b", "n_a", "n_b", F.col("of_a.matches").alias("matches"), F.slice(
        "of_a.prefix", F.lit(1), (slack_a + F.col("of_a.matches")).cast("int")).alias("head"))
    asked = F.least("matches", "of_b.matches")
    mine = F.slice("head", F.lit(1), (slack_a + asked).cast("int"))
    shared = F.array_intersect(mine, F.slice("of_b.prefix", F.lit(1), (slack_b + asked).cast("int")))
    cross = cross.join(second_own, "b").withColumn("shared", shared).filter(F.size("shared") >= asked)
    # what is shared up to the last common shingle of the prefixes, and all that can follow it
    last = F.element_at("shared", -1)
    most = F.size("shared") + F.least(F.col("n_a") - F.array_position("head", last),
                                      F.col("n_b") - F.array_position("of_b.prefix", last))
    cross = cross.filter(most * (num + den) >= (F.col("n_a") + F.col("n_b")) * num)
    cross = stored(cross.select("a", "b"), "close-pairs")
    second = _verified(docs, reps, cross, k, num, den)

    links = first.unionByName(second)
    groups = components(links.select(F.explode(F.array("a", "b")).alias("v")).distinct(), links, [])
    labelled = rows.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "sig").join(
        groups.select(F.col("v").alias("sig"), "label"), "sig", "left").withColumn(
        "label", F.when(F.col("n_shingles") > 0, F.coalesce("label", "sig")))
    labelled = stored(labelled.drop("sig"), "labelled")
    discard(rows, live, best, first, group, placed, candidates, cross, second)
    lowest = labelled.filter("label is not null").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    return labelled.join(lowest, "label", "left").select(
        "doc_id", "text_hash", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"),
        F.col("label").alias("group"))


def one_of_each_group(docs: DataFrame, **parameters) -> DataFrame:
    """One row of `docs` for each group of `similar_groups`, all its columns as they were.

    The row with the smallest doc_id stays (ties by text hash; of equal rows one). Documents with
    empty sets are no copies of each other and all stay.
    """
    groups = similar_groups(docs, **parameters).filter("n_shingles > 0").select("doc_id", "text_hash", "group")
    several = groups.groupBy("group").agg(F.min(F.struct("doc_id", "text_hash")).alias("kept"),
                                          F.count("*").alias("rows")).filter("rows > 1")
    stays = F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("text_hash") == F.col("kept.text_hash"))
    grouped = stored(groups.join(several, "group").select("doc_id", "text_hash", stays.alias("stays")).distinct(), "grouped-rows")
    # only rows that may be in a group of several are shuffled
    marked = maybe_marked(docs.withColumn("__hash", F.xxhash64(text_or_empty())), F.xxhash64("doc_id", "__hash"),
                          grouped, F.xxhash64("doc_id", "text_hash"))
    alone = ~F.col("__maybe") | ~text_or_empty().rlike(r"[^\x20\x09-\x0D]")
    gone = grouped.filter("not stays").select(F.col("doc_id").alias("__gone_id"), F.col("text_hash").alias("__gone_hash"))
    kept = marked.filter(~alone).join(gone, F.col("doc_id").eqNullSafe(F.col("__gone_id")) &
                                      (F.col("__hash") == F.col("__gone_hash")), "left_anti")
    kept = kept.dropDuplicates(["doc_id", "__hash"])
    return kept.unionByName(marked.filter(alone)).select(*docs.columns)
