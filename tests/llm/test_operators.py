"""The operators against brute force on small tables, with nulls, blanks, ties, repeats and long texts."""

import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fieldtally.llm import (chat_format, decontaminate, embedding_dedup, hashing, jaccard_join, line_dedup, mixing,
                            quality, secret_scan, token_records, toxicity)

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def lexicon(seed, n=400):
    r = random.Random(seed)
    return ["".join(r.choice("abcdeghimnoprstu") for _ in range(r.randint(2, 9))) for _ in range(n)]


def corpus(seed=5, n=60):
    """Texts with copies, near copies, shared passages, nulls, blanks and a long one."""
    r, lex = random.Random(seed), lexicon(seed)
    make = lambda k: [r.choice(lex) for _ in range(k)]
    passage, texts = make(30), []
    for i in range(n):
        w = make(r.randint(3, 120))
        if i % 4 == 0:
            w += passage
        texts.append(w)
        if i % 3 == 0:
            for edits in (0, 1, 1, 2, 4):
                v = list(w)
                for _ in range(edits):
                    v[r.randrange(len(v))] = r.choice(lex)
                texts.append(v)
    texts = [" ".join(t) if i % 5 else "\n".join([" ".join(t[j:j + 12]) for j in range(0, len(t), 12)])
             for i, t in enumerate(texts)]
    texts += [None, "", "  \n ", "one", "One", "two words", "two  words", " ".join(make(30_000)), "x" * 5000]
    return texts


@pytest.fixture(scope="module")
def texts():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", f"s{i % 4}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]
    rows.append(rows[3])  # a repeated row
    return spark.createDataFrame(rows, DOCS).repartition(4)


def empty(spark, schema):
    return spark.createDataFrame([], schema)


def smallest(n, links):
    at = list(range(n))

    def root(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        at[b] = a
    return [root(i) for i in range(n)]


# ---- words and shingles -------------------------------------------------------------------------------------------

@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("aB c\t\né,", max_size=40)), max_size=12), st.sampled_from([5, 17, 1 << 20]))
def test_word_hashes(texts, piece):
    old, hashing.PIECE = hashing.PIECE, piece
    try:
        hashes, offsets = hashing.word_hashes(pa.array(texts, pa.string()))
    finally:
        hashing.PIECE = old
    known = {}
    for i, t in enumerate(texts):
        own = words(lowered(t))
        assert offsets[i + 1] - offsets[i] == len(own)
        for w, h in zip(own, hashes[offsets[i]:offsets[i + 1]]):
            assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known)


# ---- 1 ------------------------------------------------------------------------------------------------------------

def test_vectors(spark):
    r = np.random.default_rng(2)
    base = r.standard_normal((40, 24))
    near = [b + r.standard_normal(24) * s for b in base[:20] for s in (0.02, 0.05, 0.08, 0.1)]
    rows = [(i, [float(x) for x in v], int(i % 2)) for i, v in enumerate([*base, *near])]
    n = len(rows)
    rows += [(n, rows[0][1], 0), (n + 1, [2 * x for x in rows[0][1]], 0), (n + 2, rows[0][1], None), (n + 3, None, 1),
             (n + 4, [0.0] * 24, 1), (n + 5, [float("nan")] * 24, 1), (n + 6, [None] * 24, 1), (n + 7, [], 1),
             (n + 8, [1.0, 2.0], 0), (n + 9, [2.0, 4.0], 0), (n + 10, [float("inf")] + [1.0] * 23, 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumnRenamed("x", "y")
    single = [None if v is None or not v or None in v else np.array(v, np.float32).astype(float) for _, v, _ in rows]

    def linked(a, b):
        x, y = single[a], single[b]
        if x is None or y is None or rows[a][2] is None or rows[a][2] != rows[b][2] or len(x) != len(y):
            return False
        with np.errstate(all="ignore"):
            return bool(x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93) and np.isfinite(x @ x) and x @ x > 0

    links = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if linked(a, b)]
    assert len(links) > 40
    component = smallest(len(rows), links)
    want = {i: (sum(i in p for p in links), component[i], component[i] == i) for i in range(len(rows))}
    for side, block in ((embedding_dedup.SIDE, 8), (5, 7)):
        old, embedding_dedup.SIDE = embedding_dedup.SIDE, side
        try:
            got = embedding_dedup.near_vectors(frame, block=block).collect()
        finally:
            embedding_dedup.SIDE = old
        assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == want
    assert embedding_dedup.near_vectors(frame.limit(0)).count() == 0


# ---- 2 ------------------------------------------------------------------------------------------------------------

def base_spans(text):
    out = []
    for rank, (kind, pattern, group, least) in enumerate((
            ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
            ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24))):
        out += [(m.start(), rank, m.end(), kind) for m in re.finditer(pattern, text or "", re.ASCII)
                if len(m[group]) >= least]
    return sorted(out)


def test_secrets(spark):
    wide, rare = "Zx9" * 9, "Qw8" * 9
    texts = [None, "", "no secret here", "password=abc", "password=abcdef", "é😀 Token : \"abcdefgh\" x",
             "secret=token =abcdefg", "AKIA" + "A" * 16, "AKIAAKIA" + "B" * 9, "0" * 24 + " " + "0" * 23,
             "api_key='" + "0123456789abcdef" * 2 + "'", f"a {wide} b", f"{wide}", f"{wide} {rare}",
             "token=" + "k" * 6 + " token=" + "k" * 6, "password=abcdef", "password " * 3000 + "passwd:abcdefg"]
    rows = [(i, t, f"s{i % 5}") for i, t in enumerate(texts)] + [(3, texts[3], "s3"), (None, texts[4], None)]
    got = secret_scan.secret_spans(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    for i, t in enumerate(texts):
        spans = base_spans(t)
        written = ",".join(f"{k}:{s}:{e}" for s, _, e, k in spans)
        row = by_id[i]
        assert [row.n_assign, row.n_access, row.n_hex] == [sum(x[3] == k for x in spans) for k in ("assign", "access", "hex")]
        assert row.base_sha256 == __import__("hashlib").sha256(written.encode()).hexdigest()
        added = [x for x in row.spans.split(",") if x.startswith("owned")]
        assert ",".join(x for x in row.spans.split(",") if x not in added) == written
        # a token of three sources is a copied example, one of a single source is an owner's
        assert added == ([f"owned:{len(wide) + 1}:{len(wide) + 1 + len(rare)}"] if t and rare in t else [])
    assert secret_scan.secret_spans(empty(spark, DOCS)).count() == 0


# ---- 3 ------------------------------------------------------------------------------------------------------------

@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([*"\\#<>/turn: ab\n", "###", "</turn>", "### Assistant: "]), max_size=12).map("".join),
       st.text(max_size=12))
def test_turns_round_trip(role, text):
    for r, t in ((role, text), (text, role), (role + text, text + role)):
        piece, begin, end = chat_format.render_turn(r, t)
        assert chat_format.parse_turn(piece) == (r, t, begin, end, len(piece))
        assert chat_format.parse_turn(piece + piece, len(piece))[:2] == (r, t)


def test_conversations(spark):
    hard = "\\### Assistant: </turn> ok"
    rows = [(1, 1, "assistant", hard), (1, 0, "user", None), (1, 0, "user", hard), (None, 0, None, "x"), (2, None, "assistant", ""),
            (2, 5, "assistant", "y" * 20_000), (2, 5, "assistant", "y" * 20_000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_turns(frame)).collect()}
    sha = lambda t: __import__("hashlib").sha256(t.encode()).hexdigest()
    assert got[1].turns_sha256 == sha(f"user\n\nuser\n{hard}\nassistant\n{hard}\n")
    assert (got[1].n_turns, got[1].loss_chars, got[1].loss_sha256) == (3, len(hard), sha(hard))
    assert (got[2].n_turns, got[2].loss_chars) == (3, 40_000)
    assert (got[None].n_turns, got[None].loss_chars, got[None].loss_sha256) == (1, 0, sha(""))
    assert chat_format.read_back(chat_format.format_turns(frame.limit(0))).count() == 0


@pytest.mark.parametrize("kind,ids", [("long", (2 ** 53, 2 ** 53 + 1, -(2 ** 63), None)), ("string", ("a", "b", "", None))])
def test_conversation_ids_stay_apart(spark, kind, ids):
    """Ids that a double cannot tell apart, beside a null one, and ids of another type."""
    rows = [(c, turn, role, f"text {n}") for n, c in enumerate(ids) for turn, role in ((0, "user"), (1, "assistant"))]
    frame = spark.createDataFrame(rows, f"conv_id {kind}, turn long, role string, text string").coalesce(1)
    got = {r.conv_id: (r.n_turns, r.loss_chars) for r in chat_format.read_back(chat_format.format_turns(frame)).collect()}
    assert got == {c: (2, 6) for c in ids}


# ---- 4 ------------------------------------------------------------------------------------------------------------

def test_mix(docs, texts, spark):
    got = mixing.mix(docs.withColumn("row", docs.doc_id).withColumn("key", docs.text)).collect()
    assert len(got) == len(texts) + 1
    total = sum(r["size"] for r in got)
    sizes, taken, target = {}, {}, {}
    for r in got:
        assert r["size"] == len(words(r.text)) and r.taken == r.copies * r["size"] <= 2 * r["size"]
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
    left, share, open_ = 1.5 * total, {}, dict(zip([*sorted(s for s in sizes if s), None], itertools.cycle((3, 1, 2))))
    while open_:  # water level by rounds
        level = left / sum(open_.values())
        full = [s for s, w in open_.items() if level * w > 2 * sizes[s]]
        if not full:
            share |= {s: level * w for s, w in open_.items()}
            break
        for s in full:
            share[s] = 2.0 * sizes[s]
            left -= share[s]
            del open_[s]
    largest = max(r["size"] for r in got)
    for s in sizes:
        assert target[s] == pytest.approx(share[s])
        assert abs(taken[s] - target[s]) <= 2 * largest
    assert sum(taken.values()) <= 1.5 * total
    again = mixing.mix(docs.repartition(7).withColumn("row", docs.doc_id)).collect()
    key = lambda rows: sorted((r.doc_id, r.taken) for r in rows)
    assert key(again) == key(got)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in got)
    assert mixing.mix(empty(spark, DOCS)).count() == 0


# ---- 5 ------------------------------------------------------------------------------------------------------------

@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "the", " ", "  ", "\n", "\t", ".", "'s", "é", "_", "12", "½", "<|endoftext|>", "中",
                                 "\xa0", "\x1c", "\x85", "😀"]), max_size=10).map("".join))
def test_word_coder(text):
    coder = token_records.coder(VOCABULARY)
    want = coder.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(coder.encode(text), coder.kind).tolist() == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab Z.,\n\t'7$\u00e9\u00a0\u3000", max_size=20), max_size=8))
def test_words_looked_up_at_once(texts):
    """Texts of one batch, of words between single blanks or not, have the ids of the tokenizer, in order."""
    words, plain = token_records.coder(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    got = [np.frombuffer(ids, words.kind).tolist() for some in words.encode_all(pa.array(["x", *texts]).slice(1)) for ids in some]
    assert got == [plain.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "The", "été", "ǅ", "中", "e\u0301", "12", "½", ".", ",", "...", "***", "'", "'s", "_", "|>",
                                          "<|endoftext|>", "’", " ", "\n", "  "]), max_size=9).map("".join), max_size=6))
def test_words_with_last_punctuation(texts):
    plain, words = Tokenizer.from_file(VOCABULARY), token_records.coder(VOCABULARY)
    got = [np.frombuffer(ids, words.kind).tolist() for some in words.encode_all(pa.array(texts, pa.string())) for ids in some]
    assert got == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_words_that_come_again_stay_remembered(monkeypatch):
    """Many words that come once, more than are remembered, do not push out those that come again; with stops they are the same."""
    monkeypatch.setattr(token_records, "MOST_WORDS", 80)
    coder, asked, r = token_records.WordCoder(VOCABULARY), [], random.Random(2)
    model = coder.model

    class Asked:
        def tokenize(self, word):
            asked.append(word)
            return model.tokenize(word)

    coder.model = Asked()
    name = lambda: "".join(r.choices("abcdefgh", k=12))
    often = [name() for _ in range(20)]
    plain = Tokenizer.from_file(VOCABULARY)
    for at in range(6):
        texts = [" ".join(["So", *often, *[name() for _ in range(200)], *[w + "." for w in often], often[0] + "***"]) for _ in range(2)]
        got = [np.frombuffer(ids, coder.kind).tolist() for some in coder.encode_all(pa.array(texts)) for ids in some]
        assert got == [plain.encode(t, add_special_tokens=False).ids for t in texts]
        if at == 0:
            assert sum(word[1:] in often for word in asked) == 20
            asked.clear()
        assert len(coder.words) + len(coder.words.older) <= 80
    assert len(asked) >= 2000 and not any(word[1:] in often for word in asked)


def test_other_tokenizers_encode_as_they_are():
    """A file that cuts texts in another way is not encoded by words."""
    path = public_tokenizers.path("word_bpe_49k.json")
    words, plain = token_records.coder(path), Tokenizer.from_file(path)
    texts = ["One sentence, of words.", "two\nlines  and blanks", ""]
    got = [np.frombuffer(ids, words.kind).tolist() for some in words.encode_all(pa.array(texts)) for ids in some]
    assert got == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_records(docs, texts, spark, tmp_path):
    folder = str(tmp_path / "records")
    extra = docs.withColumn("start", docs.doc_id)
    null_id = spark.createDataFrame([(None, "no id", None, None, 0)], DOCS)
    token_records.write_records(extra.drop("start").unionByName(null_id), VOCABULARY, folder)
    got = token_records.read_index(spark, folder).orderBy("start").collect()
    tokenizer = Tokenizer.from_file(VOCABULARY)
    order = [(None, "no id"), *sorted([*enumerate(texts), (3, texts[3])], key=lambda x: x[0])]
    at = 0
    for row, (doc, text) in zip(got, order, strict=True):
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], dtype="<u4")
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32) == (doc, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    payload = token_records.read_payloads(spark, folder).filter("doc_id = 5").first()
    assert np.frombuffer(payload.ids, "<u4").tolist() == tokenizer.encode(texts[5], add_special_tokens=False).ids + [0]
    # the index leads a reader to any record without the others
    row = next(r for r in got if r.doc_id == 5)
    name = next((tmp_path / "records" / "records").glob(row.shard.split("-c")[0].split(".")[0] + "-*"))
    at, found = next(token_records.frames(memoryview(name.read_bytes())[row.offset:]))
    assert len(found) == row.length
    with pytest.raises(ValueError):
        list(token_records.frames(memoryview(b"\x01" + name.read_bytes()[1:])))
    assert token_records.encoded(empty(spark, DOCS), VOCABULARY).count() == 0


# ---- 6 ------------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("k,num", [(3, 90), (5, 80), (2, 50)])
def test_jaccard(docs, texts, spark, k, num):
    sets = []
    for t in texts:
        w = words(lowered(t))
        sets.append({tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    links = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2)
             if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    component = smallest(len(texts), links)
    got = jaccard_join.similar_groups(docs.withColumn("sig", docs.doc_id), k, num, 100).collect()
    assert len(got) == len(texts) + 1
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == \
        {i: (len(s), component[i]) for i, s in enumerate(sets)}
    kept = jaccard_join.one_of_each_group(docs, k=k, num=num, den=100)
    assert kept.columns == docs.columns
    blank = {i for i, s in enumerate(sets) if not s}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(component) | blank)
    nameless = docs.select(F.lit(None).cast("long").alias("doc_id"), "text")
    assert jaccard_join.one_of_each_group(nameless, k=k, num=num, den=100).count() == \
        len(set(component) - blank) + len(blank)
    assert jaccard_join.similar_groups(empty(spark, DOCS), k, num, 100).count() == 0


def test_jaccard_hot_group(spark):
    """Many variants of one text, more than a group of postings, are tied by few pairs."""
    r, lex = random.Random(8), lexicon(8)
    base = [r.choice(lex) for _ in range(100)]
    texts = [" ".join(base)]
    for _ in range(300):
        v = list(base)
        for _ in range(r.choice([1, 1, 2, 3])):
            v[r.randrange(100)] = r.choice(lex)
        texts.append(" ".join(v))
    old = jaccard_join.GROUP, jaccard_join.CELLS
    jaccard_join.GROUP, jaccard_join.CELLS = 40, 1 << 16
    try:
        got = jaccard_join.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 3, 90, 100)
        got = {x.doc_id: x.component_id for x in got.collect()}
    finally:
        jaccard_join.GROUP, jaccard_join.CELLS = old
    sets = [frozenset(zip(w, w[1:], w[2:])) for w in map(str.split, texts)]
    links = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2)
             if 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])]
    assert got == dict(enumerate(smallest(len(texts), links)))


# ---- 7 and 9 ------------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def labelled(spark):
    r, lex = random.Random(4), lexicon(4)
    rows, labels = [], []
    for i in range(700):
        w = [r.choice(lex) for _ in range(r.randint(20, 60))]
        toxic, bad = int(r.random() < 0.3), int(r.random() < 0.3)
        for _ in range(3 * toxic):
            w.insert(r.randrange(len(w)), r.choice(["vileword", "badword", "meanword"]))
        if bad:
            w = [x.upper() + "!!" for x in w[:6]] * 5
        rows.append((i, " ".join(w), "en", "s", 0))
        if i % 2 == 0 or i % 5 == 0:
            labels.append((i, 1 - bad, toxic))
    rows += [(9000, None, None, None, None), (9001, "", None, None, None), (9002, " \n", None, None, None),
             (9003, "z" * 10_000, None, None, None), (None, "a b c", None, None, None), rows[7]]
    labels += [(5, None, None), (9000, 1, 0), (None, 1, 1)]
    truth = {i: (q, t) for i, q, t in labels}
    return (spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows, truth)


@pytest.mark.parametrize("module,place,cut", [(quality, 0, 0.3), (toxicity, 1, 0.5)])
def test_classifiers(labelled, spark, module, place, cut):
    docs, labels, rows, truth = labelled
    got = module.score(docs.withColumn("score", docs.n_chars), labels).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= cut)
        assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    # quality labels of shouted texts hide the toxic words of theirs, as these are cut away
    held = [(r.predicted, truth[r.doc_id][place]) for r in got if r.held_out and r.doc_id is not None and r.doc_id in truth and r.doc_id < 9000
            and truth[r.doc_id][place] is not None and (place == 0 or truth[r.doc_id][0] == 1)]
    assert sum(p == t for p, t in held) / len(held) > 0.93
    # labels of held-out rows teach nothing
    again = module.score(docs, labels.filter(module.fold(F.col("doc_id")) != 0))
    assert sorted((r.doc_id or -1, r.score) for r in again.collect()) == sorted((r.doc_id or -1, r.score) for r in got)
    nothing = module.score(docs, labels.limit(0)).collect()
    assert all(0 <= r.score <= 1 for r in nothing) and len(nothing) == len(rows)
    assert module.score(docs.limit(0), labels).count() == 0


def test_without_toxic(labelled):
    docs, labels, rows, _ = labelled
    out = toxicity.without_toxic(docs, labels)
    keep = toxicity.score(docs, labels).filter("predicted = 0").count()
    assert out.columns == docs.columns and out.count() == keep < len(rows)


def test_words_have_counts_of_their_own(labelled, spark):
    """An unseen word whose hash ends like that of a toxic word scores as any other unseen word."""
    docs, labels, rows, _ = labelled
    names = ["vileword", *[f"w{i}q" for i in range(2_000_000)]]
    hashes = hashing.word_hashes(pa.array([" ".join(names)]))[0]
    low = hashes & np.uint64((1 << 20) - 1)
    twin = names[1 + int(np.flatnonzero(low[1:] == low[0])[0])]
    more = [(9100, f"{twin} {twin} {twin}", None, None, None), (9101, "unseen unseen unseen", None, None, None),
            (9102, "vileword vileword vileword", None, None, None)]
    all_docs = docs.unionByName(spark.createDataFrame(more, DOCS))
    got = {r.doc_id: r.score for r in toxicity.score(all_docs, labels).collect() if r.doc_id and r.doc_id >= 9100}
    assert got[9100] == pytest.approx(got[9101]) and got[9102] > got[9100] + 0.1


def test_word_models_by_hand(labelled, spark):
    """Continuation counts, discounts and ratios against plain Python, and the words whose ratio is that of an unseen one."""
    docs, labels, rows, truth = labelled
    taught = [(text, truth[i][1]) for i, text, *_ in rows[:700] if i in truth and truth[i][1] is not None
              and zlib.crc32(str(i).encode()) % 5 > 1]
    histories = [{}, {}, {}]
    for text, toxic in taught:
        w = [""] + lowered(text).split()
        for before, word in zip(w, w[1:]):
            for c in (0 if toxic else 1, 2):
                histories[c].setdefault(word, set()).add(before)
    n = [{w: len(h) for w, h in of.items()} for of in histories]
    table = spark.createDataFrame(taught, "text string, y int")
    frequent = toxicity.frequent_words(table)
    counts = toxicity.continuation_counts(table, frequent)
    names = sorted(n[2])
    codes = dict(zip(hashing.word_hashes(pa.array([" ".join(names)]))[0].view(np.int64).tolist(), names))
    got = {codes[r.word]: (r.toxic, r.ordinary, r.either) for r in counts.collect()}
    assert got == {w: tuple(of.get(w, 0) for of in n) for w in names}
    model = toxicity.kneser_ney(counts, frequent)
    total = [sum(of.values()) for of in n]

    def ratio(word, d):
        shared = (n[2].get(word, 0) + 0.5) / (total[2] + 0.5 * (len(names) + 1))
        p = [(max(n[c].get(word, 0) - d, 0) + sum(min(x, d) for x in n[c].values()) * shared) / total[c] for c in (0, 1)]
        return np.log(p[0]) - np.log(p[1])

    for i, d in enumerate(toxicity.DISCOUNTS):
        value = model.log_ratios(*[np.array([of.get(w, 0) for w in names], dtype=float) for of in n])[i]
        assert value == pytest.approx([ratio(w, d) for w in names])
        telling = {codes[r.word] for r in toxicity.telling(counts, model.only(i)).collect()}
        assert all(ratio(w, d) == pytest.approx(ratio("not a word", d)) for w in names if w not in telling)
        bitmap = toxicity.word_filter(toxicity.telling(counts, model.only(i)))
        inside = toxicity._may_hold(bitmap, hashing.word_hashes(pa.array([" ".join(names)]))[0])
        assert telling <= {w for w, x in zip(names, inside) if x} and 0 < inside.sum()


@pytest.mark.parametrize("share", [1.0, 0.003])
def test_joined_words_score_as_frequent_ones(labelled, spark, share):
    """Scores do not depend on which words are looked up in memory: none, some, or all of them."""
    docs, labels, rows, _ = labelled
    want = sorted((r.doc_id or -1, r.score) for r in toxicity.score(docs, labels).collect())
    old, toxicity.SHARE = toxicity.SHARE, share
    try:
        got = sorted((r.doc_id or -1, r.score) for r in toxicity.score(docs, labels).collect())
    finally:
        toxicity.SHARE = old
    assert [i for i, _ in got] == [i for i, _ in want]
    assert [s for _, s in got] == pytest.approx([s for _, s in want], abs=1e-9)


@pytest.mark.parametrize("n", [3, 9, 15, 23])
def test_dictionary_pieces_reach_the_end(spark, monkeypatch, n):
    """The eight pieces of a text are spread evenly: piece i * n // 8, or all of fewer."""
    monkeypatch.setattr(quality, "_dictionary", b"".join)
    r = random.Random(n)
    names = [f"<piece{i:02d}>" for i in range(n)]
    text = "".join(x + "".join(r.choice("abcdefgh") for _ in range(quality.PIECE - len(x))) for x in names)
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5 > 1][:2]
    frame = spark.createDataFrame([(i, text) for i in ids], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for y, i in enumerate(ids)], "doc_id long, quality int")
    want = {names[i * n // 8] for i in range(8)} if n > 8 else set(names)
    for dictionary in quality.train(frame, labels)[0]:
        assert {x for x in names if x.encode() in dictionary} == want


# ---- 8 ------------------------------------------------------------------------------------------------------------

def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_lines(spark):
    r, lex = random.Random(9), lexicon(9, 40)
    lines = []
    for n in [*range(1, 40), 8, 9, 15, 16, 17, 31, 32, 33]:
        w = [r.choice(lex) for _ in range(n)]
        lines += [w, list(w)]
        for _ in range(3):
            v = list(w)
            for _ in range(r.choice([1, 1, 2])):
                at = r.randrange(len(v) + 1)
                kind = r.choice("cia" if v else "i")
                if kind == "i":
                    v.insert(at, r.choice(lex))
                elif at < len(v):
                    v[at:at + 1] = [r.choice(lex)] if kind == "c" else []
            lines.append(v)
    r.shuffle(lines)
    lines = [" ".join(w) for w in lines]
    texts = ["\n".join(lines[i:i + 7]) for i in range(0, len(lines), 7)] + [None, "", "\n\n", "a\na", " a ", "w " * 3000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0])]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    seen, want = [], {}
    for i, t in enumerate(texts):
        dropped = [0, 0, []]
        for no, line in enumerate((t or "").split("\n")):
            w = words(line)
            if not w:
                continue
            exact = w in seen
            near = len(w) >= 8 and any(len(s) >= 8 and abs(len(s) - len(w)) <= 1 and edits(s, w) == 1 for s in seen)
            if exact or near:
                dropped[0 if exact else 1] += 1
                dropped[2].append(no)
            seen.append(w)
        want[i] = (len((t or "").split("\n")), dropped[0], dropped[1], ",".join(map(str, dropped[2])))
    got = line_dedup.line_report(frame.withColumn("line", frame.text)).collect()
    assert {r.doc_id: (r.n_lines, r.n_exact, r.n_near, r.dropped) for r in got} == want and len(got) == len(texts)
    assert sum(w[2] for w in want.values()) > 10
    clean = {(r.doc_id, r.text) for r in line_dedup.without_repeated_lines(frame).collect()}
    assert clean == {(i, t if not want[i][3] else "\n".join(x for no, x in enumerate(t.split("\n"))
                                                            if str(no) not in want[i][3].split(","))) for i, t in enumerate(texts)}
    assert line_dedup.line_report(empty(spark, DOCS)).count() == 0


# ---- 10 -----------------------------------------------------------------------------------------------------------

def test_masks_lose_nothing():
    """Whatever up to SUBSTITUTIONS words of a window differ, some mask fits between them."""
    places = range(decontaminate.WINDOW)
    for k in range(decontaminate.SUBSTITUTIONS + 1):
        for bad in itertools.combinations(places, k):
            assert any(not {s + o for o in m} & set(bad) for m in decontaminate.MASKS
                       for s in range(decontaminate.WINDOW - m[-1]))


def test_leaks(spark):
    r, lex = random.Random(6), lexicon(6)
    make = lambda n: [r.choice(lex) for _ in range(n)]
    items = [make(n) for n in (12, 13, 20, 40, 60)]
    items.append(list(items[2]))  # the same words under another id
    docs = []
    for _ in range(120):
        w = make(r.randint(0, 40))
        if r.random() < 0.6:
            piece = list(r.choice(items))
            for _ in range(r.choice([0, 1, 2, 3, 6])):
                piece[r.randrange(len(piece))] = r.choice(lex)
            piece = piece[r.randint(0, 3):]
            at = r.randint(0, len(w))
            w[at:at] = piece
        docs.append(w)
    docs += [[], make(20_000) + items[3]]

    def best(doc, item):
        found = []
        for shift in range(-len(item), len(doc)):
            first = max(shift, 0)
            n = min(len(item) + shift, len(doc)) - first
            same = [doc[first + i] == item[first - shift + i] for i in range(max(n, 0))]
            if n >= 13 and max(sum(same[i:i + 13]) for i in range(n - 12)) >= 11:
                found.append((sum(same), n, -first))
        return max(found, default=None)

    want = set()
    for (i, d), (j, item) in itertools.product(enumerate(docs[:-1]), enumerate(items)):
        if len(item) >= 13 and (b := best(d, item)):
            want.add((i, j, -b[2], b[1], b[0]))
    want.add((len(docs) - 1, 3, 20_000, 40, 40))
    rows = [(i, " ".join(w).upper() if i % 2 else "  " + "\n".join(w)) for i, w in enumerate(docs)]
    frame = spark.createDataFrame([*rows, rows[0], (None, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(j, " ".join(w)) for j, w in enumerate(items)] + [(99, None), (None, "short")],
                                  "item_id long, text string")
    for most in (decontaminate.BROADCAST_ROWS, 0):
        old, decontaminate.BROADCAST_ROWS = decontaminate.BROADCAST_ROWS, most
        try:
            got = decontaminate.leaks(frame.withColumn("at", frame.doc_id), bench).collect()
        finally:
            decontaminate.BROADCAST_ROWS = old
        assert {(x.doc_id, x.item_id, x.first_word, x.n_words, x.n_equal) for x in got} == want
    clean = decontaminate.without_leaks(frame, bench)
    assert sorted(x.doc_id for x in clean.filter("doc_id is not null").collect()) == \
        sorted([i for i in range(len(docs)) if i not in {w[0] for w in want}] + [0] * (0 not in {w[0] for w in want}))
    assert decontaminate.leaks(frame, bench.limit(0)).count() == decontaminate.leaks(frame.limit(0), bench).count() == 0
