"""Every stage of the pipeline against brute force on its own input."""

import itertools
import os
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from fieldtally.llm import toxicity
from fieldtally.llm.common import load, stored

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables not present")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def kept(spark):
    """What each stage keeps, written and read again; documents first."""
    docs = load(spark, FOLDER, "documents")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], FOLDER), name))
    return out


def test_columns(kept):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_copies", "leaks", "mix", "token_records"]
    for docs in kept[:-1]:
        assert docs.columns == kept[0].columns
    assert entry.queries()["pipeline"] is corpus_pipeline.run


def test_toxicity(spark, kept):
    rejected = toxicity.score(kept[0], load(spark, FOLDER, "labels")).filter("predicted = 1").select("doc_id")
    assert sorted(r.doc_id for r in kept[1].collect()) == sorted(
        r.doc_id for r in kept[0].join(rejected, "doc_id", "left_anti").collect())


def test_near_copies(kept):
    rows = kept[1].orderBy("doc_id").collect()
    sets = []
    for r in rows:
        w = words(lowered(r.text))
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(rows)))
    for a, b in itertools.combinations(group, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            low, high = sorted((group[a], group[b]))
            group = [low if g == high else g for g in group]
    assert sorted(r.doc_id for r in kept[2].collect()) == [r.doc_id for i, r in enumerate(rows) if group[i] == i]


def test_leaks(spark, kept):
    items = [words((r.text or "").lower()) for r in load(spark, FOLDER, "benchmark").collect()]
    items = [w for w in items if len(w) >= 13]

    def leaked(text):
        w = words((text or "").lower())
        for item in items:
            for shift in range(-len(item), len(w)):
                first = max(shift, 0)
                same = [w[first + i] == item[first - shift + i]
                        for i in range(max(0, min(len(item) + shift, len(w)) - first))]
                if any(sum(same[i:i + 13]) >= 11 for i in range(len(same) - 12)):
                    return True
        return False

    rows = [r for r in kept[2].collect()]
    common = {x for item in items for x in item}
    suspects = {r.doc_id for r in rows if len(set(words((r.text or "").lower())) & common) >= 8 and leaked(r.text)}
    assert suspects
    assert sorted(r.doc_id for r in kept[3].collect()) == sorted(r.doc_id for r in rows if r.doc_id not in suspects)


def test_mix(kept):
    size = F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    before = {r.source: r.n for r in kept[3].groupBy("source").agg(F.sum(size).alias("n")).collect()}
    after = {r.source: r.n for r in kept[4].groupBy("source").agg(F.sum(size).alias("n")).collect()}
    assert sum(after.values()) <= 1.5 * sum(before.values()) and sum(after.values()) >= 1.2 * sum(before.values())
    assert all(after.get(s, 0) <= 2 * n for s, n in before.items())
    assert max(r["count"] for r in kept[4].groupBy("doc_id").count().collect()) <= 2


def test_token_records(kept):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    at, got = 0, kept[5].orderBy("start").collect()
    for row, doc in zip(got, kept[4].orderBy("doc_id").collect(), strict=True):
        ids = np.array(tokenizer.encode(doc.text or "", add_special_tokens=False).ids + [0], dtype="<u4")
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32) == (doc.doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
