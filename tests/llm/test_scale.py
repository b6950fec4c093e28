"""What the operators leave on disk, shuffle and pair up, on small tables."""

import os
import random
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from fieldtally.llm import common, embedding_dedup, hashing, jaccard_join, line_dedup, toxicity


def shuffle_files(spark):
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f for top in folders for _, _, names in os.walk(top.getPath()) for f in names if f.startswith("shuffle_")}


def test_stored_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    kept = common.stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "few")
    until = time.time() + 20
    while (left := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.2)
    assert not left
    assert kept.count() == 7
    assert spark.conf.get(common.SHUFFLE_CLEANUP) == "false"


def test_words_of_several_texts_are_looked_up_once(spark):
    texts = [(i, "rare words " * 3 + f"own{i}") for i in range(5)] + [(None, ""), (9, "rare")]
    table = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    learned = table.withColumn("y", (F.coalesce("doc_id", F.lit(0)) % 2).cast("int"))
    counts = common.stored(toxicity.continuation_counts(learned, np.zeros(0, np.uint64)), "counts")
    model = toxicity.kneser_ney(counts, np.zeros(0, np.uint64)).only(1)
    rows = toxicity._measured(table, counts, model, "looked-up").collect()
    assert sorted(x or -1 for r in rows for x in r.doc_id) == sorted(x[0] or -1 for x in texts)
    assert len(rows) == 1 and rows[0].distinct == 7 == len(rows[0].found)
    assert sum(rows[0].rare) == len(rows[0].at) == 5 * 7 + 1


def word_corpus():
    r = random.Random(11)
    lex = [f"w{i}" for i in range(400)]
    texts = [" ".join(["bad" * (i % 2) or "good", *r.choices(lex, k=30 + i % 50)]) for i in range(600)] + ["", None, "w1 unheard", "bad"]
    return list(enumerate(texts)), [(i, i % 2) for i in range(600)]


def scores_with(spark, monkeypatch, at_hand):
    """Scores of a small corpus with so many words in memory, and how many words were looked up when texts were scored."""
    looked_up = {}

    def counted(df, name, keep=toxicity.stored):
        out = keep(df, name)
        if "words" in out.columns:
            looked_up[name] = out.agg(F.sum(F.size("words"))).first()[0]
        return out

    monkeypatch.setattr(toxicity, "stored", counted)
    monkeypatch.setattr(toxicity, "SHARE", 0.5)  # no frequent words
    monkeypatch.setattr(toxicity, "AT_HAND", at_hand)
    texts, marks = word_corpus()
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(6, "doc_id")
    scored = toxicity.score(docs, spark.createDataFrame(marks, "doc_id long, toxic int")).collect()
    return {x.doc_id: x.score for x in scored}, looked_up["text-words"]


def test_words_with_most_histories_are_not_looked_up(spark, monkeypatch):
    want, all_of_them = scores_with(spark, monkeypatch, 0)
    some, fewer = scores_with(spark, monkeypatch, 100)
    got, none = scores_with(spark, monkeypatch, 1 << 19)
    assert all_of_them > fewer > none == 0
    for other in (some, got):
        assert other.keys() == want.keys()
        np.testing.assert_allclose([other[k] for k in want], list(want.values()), rtol=1e-9)


def test_pairs_of_many_texts_are_counted_piece_by_piece(spark, monkeypatch):
    texts, marks = word_corpus()
    docs = spark.createDataFrame([(t, i % 2) for i, t in texts] * 4, "text string, y int").coalesce(1)

    def counts():
        return sorted(map(tuple, toxicity.continuation_counts(docs, np.zeros(0, np.uint64)).collect()))

    want = counts()
    monkeypatch.setattr(toxicity, "MOST_PAIRS", 1)
    assert counts() == want
    table = pa.RecordBatch.from_arrays([pa.array(["a b"] * 2500), pa.array([1] * 2500, pa.int32())], names=["text", "y"])
    pieces = []
    monkeypatch.setattr(toxicity, "word_hashes", lambda texts, split=hashing.word_hashes: (pieces.append(len(texts)), split(texts))[1])

    class Rows:  # what the function is given to, without Spark
        def select(self, *_):
            return self

        def mapInArrow(self, f, _):
            self.lists = [b.num_rows for b in f([table])]
            raise StopIteration

    rows = Rows()
    try:
        toxicity.continuation_counts(rows, np.zeros(0, np.uint64))
    except StopIteration:
        pass
    assert pieces == [1000, 1000, 500] and rows.lists == [2, 2, 2]


def test_one_common_shingle_pairs_no_texts(spark, monkeypatch):
    r = random.Random(3)
    lex = ["".join(r.choice("abcdefghij") for _ in range(7)) for _ in range(5000)]
    texts = []
    for _ in range(150):
        shared = r.sample(lex, 3)  # one shingle that four otherwise different texts hold
        for _ in range(4):
            at = r.randint(0, 60)
            texts.append(" ".join([*r.choices(lex, k=at), *shared, *r.choices(lex, k=60 - at)]))
    near = texts[0].split()
    near[1] = "other"
    texts.append(" ".join(near))
    sizes = {}

    def counted(df, name, keep=jaccard_join.stored):
        out = keep(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(jaccard_join, "stored", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in jaccard_join.similar_groups(docs, 3, 90, 100).collect()}
    assert got == {i: 0 if i == len(texts) - 1 else i for i in range(len(texts))}
    assert sizes["candidates"] == 0


def test_texts_with_many_shingles_of_their_own_are_not_paired(spark, monkeypatch):
    r = random.Random(5)
    lex = ["".join(r.choice("abcdefghij") for _ in range(7)) for _ in range(5000)]
    base = r.sample(lex, 150)

    def edited(edits):
        words = list(base)
        for i in range(edits):
            words[20 * i + r.randint(5, 14)] = f"new{r.random()}"
        return " ".join(words)

    texts = [" ".join(base), *[edited(1 + i % 2) for i in range(60)], *[edited(3 + i % 2) for i in range(60)]]
    texts += [t + " one more" for t in texts[61:64]]  # each links with the text it was made from only
    sets = [{" ".join(w[i:i + 3]) for i in range(len(w) - 2)} for w in map(str.split, texts)]
    want = list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            if 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]) and want[a] != want[b]:
                low, high = sorted((want[a], want[b]))
                want = [low if x == high else x for x in want]
    assert len(set(want)) == 61
    sizes = {}

    def counted(df, name, keep=jaccard_join.stored):
        out = keep(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(jaccard_join, "stored", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in jaccard_join.similar_groups(docs, 3, 90, 100).collect()}
    assert got == dict(enumerate(want))
    assert sizes["candidates"] <= 60


def test_rows_that_cannot_leave_are_not_shuffled(spark):
    rows = [(i, f"text {i}") for i in range(400)] + [(7, "text 7"), (7, "other"), (None, "text 5"), (None, None), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    gone = [rows[7], (None, "text 5"), (None, None), (399, "text 1")]
    keys = common.stored(spark.createDataFrame(gone, docs.schema).select(
        "doc_id", F.xxhash64(common.text_or_empty()).alias("text_hash")), "keys")
    got = common.without(docs, keys)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(x) for x in rows if x not in gone)
    marked = common.maybe_marked(docs.withColumn("h", F.xxhash64(common.text_or_empty())), F.xxhash64("doc_id", "h"),
                                 keys, F.xxhash64("doc_id", "text_hash"))
    assert marked.count() == len(rows) and marked.filter("__maybe").count() <= 8


def test_words_of_some_texts_at_a_time_are_in_memory(monkeypatch):
    sizes = []
    monkeypatch.setattr(jaccard_join, "word_hashes", lambda texts: (sizes.append(len(texts)), hashing.word_hashes(texts))[1])
    texts = pa.array([f"a b c d{i % 7}" for i in range(1200)] + ["", None, "a"])
    got = [s.tolist() for s in jaccard_join._sets(texts, 3)]
    words, offsets = hashing.word_hashes(texts)
    assert got == [hashing.shingles(words[a:b], 3).tolist() for a, b in zip(offsets[:-1], offsets[1:])]
    assert len(got) == len(texts) and max(sizes) <= 500


def test_keys_and_words_of_lines_are_not_broadcast(spark, tmp_path):
    """Spark sizes them by small files: a line of 40 words gives 40 keys."""
    line = " ".join(f"word{i}" for i in range(40))
    spark.createDataFrame([(i, f"{line} end{i}\n{line} last{i % 3}") for i in range(50)], "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    verdicts = line_dedup.line_verdicts(spark.read.parquet(f"{tmp_path}/d"))
    sent = []

    def walk(node):
        if node.nodeName() == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if node.nodeName() == "BroadcastExchange":
            sent.append(node.toString())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(verdicts._jdf.queryExecution().executedPlan())
    assert not [x for x in sent if "Generate" in x or "words" in x], sent
    rows = verdicts.collect()
    assert len(rows) == 100 and sum(r.exact for r in rows) == 47 and sum(r.near for r in rows) == 99


def test_vectors_are_copied_twice_a_round_at_most(spark, monkeypatch):
    """However many squares a label is cut into; all pairs are found, those of equal vectors and of both lengths too."""
    r = np.random.default_rng(5)
    base = r.standard_normal((300, 16))
    every = [*base, *(base[:60] + 0.05 * r.standard_normal((60, 16))), *base[:20], *base[:20, :8]]
    rows = [(i, [float(x) for x in v], "x" if i % 30 else "y") for i, v in enumerate(every)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    copies, look = [], embedding_dedup._links
    monkeypatch.setattr(embedding_dedup, "SIDE", 20)
    monkeypatch.setattr(embedding_dedup, "_links", lambda placed, *rest: (copies.append(placed.count()), look(placed, *rest))[1])
    got = {x.vec_id: x for x in embedding_dedup.near_vectors(frame).collect()}
    assert len(got) == len(rows) and len(copies) > 3 and max(copies) <= 2 * len(rows)
    units = [v / np.linalg.norm(v) for v in every]
    linked = {i: {j for j in range(len(rows)) if j != i and rows[i][2] == rows[j][2] and len(units[i]) == len(units[j])
                  and units[i] @ units[j] >= 0.93} for i in range(len(rows))}
    assert sum(map(len, linked.values())) > 100
    assert {i: x.n_links for i, x in got.items()} == {i: len(x) for i, x in linked.items()}
    assert all(got[i].component_id == got[j].component_id <= i for i, x in linked.items() for j in x)
