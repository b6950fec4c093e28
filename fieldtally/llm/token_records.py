"""Token ids of documents as length-delimited binary records with an offset index."""

from __future__ import annotations

import json
import re
import string
import struct
import sys
import types
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import new_folder, text_or_empty

# A record (all numbers little-endian):
#   8 bytes length of the payload, 4 bytes masked checksum of those 8 bytes,
#   payload, 4 bytes masked checksum of the payload, one newline byte.
# The payload: 8 bytes document id, 1 byte whether there is one, 1 byte width of an id, 4 bytes
# number of ids, the ids.
_LENGTH, _CHECK, _HEAD = "<Q", "<I", "<qBBI"
MASK = 0xA282EAD8  # fixed value of the usual masked checksum
SHARD_RECORDS = 20_000
# Words a worker remembers the ids of (some 20 MB, which it keeps between tasks).
MOST_WORDS = 100_000
# Bytes of text whose words are looked up at once; a longer text is encoded by itself.
LOOKUP_BYTES = 1 << 22
# Blanks that make a text more than words between single spaces and line ends (fixed value, what Python's \s matches).
ODD_BLANKS = ("^[ \n]|[ \n]$|  | \n|\n |\n\n|"
              r"[\t\x0b-\x0d\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
# Words of one piece, maybe after a mark, and words with a run of ASCII punctuation, a piece of its own, after their last letter
# or digit (fixed values, belong to the vocabulary).
LETTERS = r"A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}"
ONE_PIECE = rf"^\x0b?[{LETTERS}]+$"
WORD_AND_END = rf"[0-9{LETTERS}][!-/:-@\[-`{{-~]+$"
LAST_END = r"(?P<end>[!-/:-@\[-`{-~]+)$"
# How byte-level pieces are cut (fixed value, belongs to the vocabulary).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?[0-9]+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"


def masked_checksum(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack(_LENGTH, len(payload))
    return length + struct.pack(_CHECK, masked_checksum(length)) + payload + struct.pack(_CHECK, masked_checksum(payload)) + b"\n"


def frames(data: memoryview) -> Iterator[tuple[int, memoryview]]:
    """Offset and payload of each record of a shard; raises on any damage."""
    at = 0
    while at < len(data):
        (n,) = struct.unpack_from(_LENGTH, data, at)
        end = at + 12 + n
        if end + 5 > len(data) or struct.unpack_from(_CHECK, data, at + 8)[0] != masked_checksum(bytes(data[at:at + 8])):
            raise ValueError(f"damaged record length at byte {at}")
        payload = data[at + 12:end]
        if struct.unpack_from(_CHECK, data, end)[0] != masked_checksum(bytes(payload)) or data[end + 4] != 10:
            raise ValueError(f"damaged record at byte {at}")
        yield at, payload
        at = end + 5


class Recent(dict):
    """Values by word, MOST_WORDS at most: the half added first goes when the other half is full, but for what was asked for since."""

    def __init__(self):
        super().__init__()
        self.older: dict[str, bytes] = {}

    def keep(self, word: str, value: bytes) -> bytes:
        if len(self) >= MOST_WORDS // 2:
            self.older = dict(self)
            self.clear()
        if len(word) < 40:
            self[word] = value
        return value

    def recall(self, word: str) -> bytes | None:
        found = self.get(word)
        if found is None and (found := self.older.get(word)) is not None:
            self.keep(word, found)
        return found


class WordCoder:
    """A tokenizer that remembers words.

    Byte-level pieces never reach over a single space between two other characters, and a single line end between two
    others is a piece, so that the ids of a text are those of its words in a row. Tokenizers with a normalizer or with
    another way of cutting pieces encode every text as it is.
    """

    _plain = re.compile(r"[\x20-\x7eÀ-ÖØ-öø-ɏ]+")
    _cut = re.compile(r"(?<=\S)(?= \S)")
    _blank = re.compile(r"[^\S \n]")

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.kind = f"<u{self.width}"
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.marked = not any(a.isalpha() for a in self.added)
        self.by_words = self._cuts_bytes() and not any(c in a for a in self.added for c in " \n")
        self.pieces = re.compile(PIECES)
        # byte-level letters: printable bytes stand for themselves, the others for letters past the bytes
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        place = {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.letters = [place.get(b, chr(b)) for b in range(256)]
        self.letter = "H" if self.width == 2 else "I"
        self.packs = [struct.Struct(f"<{n}{self.letter}").pack for n in range(16)]
        self.words = Recent()  # a word after a space, or as it stands after a mark
        self.parts = Recent()  # a byte-level piece, or a stretch of text as it stands
        self.space = self.letters[32]
        self.stops, self.line = {}, b""
        if self.by_words:
            self.line = self._piece("\n")
            self.stops = {c: self._piece(c) for c in ".," if not any(c in a for a in self.added)}

    def _cuts_bytes(self) -> bool:
        """Whether the loaded file cuts texts the way of PIECES, and changes nothing before that."""
        told = json.loads(self.tokenizer.to_str())
        cut, model = told.get("pre_tokenizer") or {}, told["model"]
        return (told.get("normalizer") is None and cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space", True)
                and cut.get("use_regex", True) and model.get("type") == "BPE" and not model.get("continuing_subword_prefix")
                and not model.get("end_of_word_suffix") and all(
                    not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] and " " in t["content"])
                    for t in told.get("added_tokens", [])))

    def _packed(self, ids: list[int]) -> bytes:
        return self.packs[len(ids)](*ids) if len(ids) < len(self.packs) else struct.pack(f"<{len(ids)}{self.letter}", *ids)

    def _shown(self, text: str) -> str:
        return text.encode().decode("latin-1").translate(self.letters)

    def _piece(self, piece: str) -> bytes:
        return self._packed([t.id for t in self.model.tokenize(self._shown(piece))])

    def _part(self, part: str) -> bytes:
        """The ids of a stretch of text that no piece reaches beyond."""
        found = self.parts.recall(part)
        if found is not None:
            return found
        if not self._plain.fullmatch(part) or "  " in part or any(a in part for a in self.added):
            return self.parts.keep(part, self._packed(self.tokenizer.encode(part, add_special_tokens=False).ids))
        pieces = self.pieces.findall(part)
        if len(pieces) == 1 and not (part[0] == " " and part[1:].isalpha()):
            return self.parts.keep(part, self._piece(part))
        ids = b"".join([self._word(p[1:]) if p[0] == " " and p[1:].isalpha() else self.parts.recall(p) or
                        self.parts.keep(p, self._piece(p)) for p in pieces])
        return self.parts.keep(part, ids) if part[0] != " " else ids

    def _word(self, word: str) -> bytes:
        """The ids of a word after a space."""
        found = self.words.recall(word)
        return self.words.keep(word, self._coded(word)) if found is None else found

    def _coded(self, word: str) -> bytes:
        """The ids of a new word after a space. Words of letters are one piece; a stop or comma after them is another."""
        if self.marked and word.isalpha():
            if word.isascii():
                return self._packed([t.id for t in self.model.tokenize(self.space + word)])
            if self._plain.fullmatch(word):
                return self._piece(" " + word)
        if word[-1:] in self.stops and word[:-1].isalpha():
            return self._word(word[:-1]) + self.stops[word[-1]]
        return self._part(" " + word)

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian numbers of `width` bytes."""
        if not text:
            return b""
        if not self.by_words:
            return self._packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if "  " in text or " \n" in text or "\n " in text or text[0] == " " or text[-1] == " " or self._blank.search(text):
            return b"".join([self._part(p) for p in self._cut.split(text)])
        lines = [text] if "\n\n" in text or text[0] == "\n" or text[-1] == "\n" else text.split("\n")
        known = self.words.get
        out = []
        for line in lines:
            first, *rest = line.split(" ")
            out += [self.line, self._part(first), *[known(w) or self._word(w) for w in rest]]
        return b"".join(out[1:])

    def encode_all(self, texts: pa.Array) -> Iterator[list[bytes]]:
        """The ids of all texts (none null) in order, in lists for some at a time. Of a list's words each is looked up once."""
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < len(texts):
            stop = max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + LOOKUP_BYTES, "right")))
            part = texts.slice(at, stop - at)
            if self.by_words and sizes[at] <= LOOKUP_BYTES:
                yield self._looked_up(part)
            else:
                yield [self.encode(text) for text in part.to_pylist()]
            at = stop

    def _looked_up(self, texts: pa.Array) -> list[bytes]:
        odd = pc.match_substring_regex(texts, ODD_BLANKS)
        words = pc.split_pattern(pc.binary_join_element_wise(
            "\x0b", pc.replace_substring(texts.filter(pc.invert(odd)), "\n", " \n"), ""), " ")
        distinct = words.flatten().dictionary_encode()
        which = distinct.indices.to_numpy()
        codes = self._codes(distinct.dictionary, np.bincount(which, minlength=len(distinct.dictionary)))
        # ids are no more than the bytes of the texts, so that 32 bits hold every place
        lengths = np.fromiter(map(len, codes), np.int32, len(codes)) // self.width
        begins = np.cumsum(lengths, dtype=np.int32) - lengths
        n = lengths[which]
        upto = np.concatenate([np.zeros(1, np.int32), np.cumsum(n, dtype=np.int32)])
        places = np.repeat(begins[which] - upto[:-1], n)
        places += np.arange(upto[-1], dtype=np.int32)
        ids = np.frombuffer(b"".join(codes), self.kind)[places]
        offsets = words.offsets.to_numpy()
        cuts = upto[offsets - offsets[0]].astype(np.int64) * self.width
        flat = memoryview(ids.tobytes())
        found = iter([bytes(flat[a:b]) for a, b in zip(cuts[:-1], cuts[1:])])
        if not pc.any(odd).as_py():
            return list(found)
        return [self.encode(text) if other else next(found) for text, other in zip(texts.to_pylist(), odd.to_pylist())]

    def _codes(self, tokens: pa.Array, times: np.ndarray) -> list[bytes]:
        """The ids of distinct words after a space, after a line end (which they begin with), or at the start (after a mark).

        Words are encoded without line end and last punctuation, each once; those that come more than once are remembered.
        """
        marked = pc.replace_substring(tokens, "\n", "\x0b")
        ended = pc.match_substring_regex(marked, WORD_AND_END)
        for added in self.added:
            ended = pc.and_not(ended, pc.match_substring(marked, added))
        keys = pc.if_else(ended, pc.ascii_rtrim(marked, string.punctuation), marked).dictionary_encode()
        ends = pc.struct_field(pc.extract_regex(marked.filter(ended), LAST_END), "end").dictionary_encode()
        last = np.zeros(len(tokens), np.int32)
        last[ended.to_numpy(zero_copy_only=False)] = ends.indices.to_numpy() + 1
        which = keys.indices.to_numpy()
        more = (np.bincount(which, times, len(keys.dictionary)) > 1).tolist()
        words = _strings(keys.dictionary)
        known, older = self.words.get, self.words.older.get
        found = [known(word) or older(word) for word in words]
        new = [i for i, ids in enumerate(found) if ids is None]
        one = _list(pc.match_substring_regex(keys.dictionary, ONE_PIECE)) if self.marked else [False] * len(words)
        shown = self._shown("\n ".join(["", *[words[i] for i in new]])).split(self.letters[10])[1:]
        tokenize, packed = self.model.tokenize, self._packed
        for i, letters in zip(new, shown):
            word = words[i]
            if one[i]:
                found[i] = packed([t.id for t in tokenize(letters if word[0] != "\x0b" else letters[2:])])
            else:
                found[i] = self._part(word[1:]) if word[0] == "\x0b" else self._coded(word)
        for word, ids, again in zip(words, found, more):
            if again and word not in self.words:
                self.words.keep(word, ids)
        before, after = [b"", self.line], [b"", *[self._part(end) for end in ends.dictionary.to_pylist()]]
        parts = zip(_list(pc.starts_with(tokens, "\n")), which.tolist(), last.tolist())
        return [before[line] + found[at] + after[end] for line, at, end in parts]


def _list(values: pa.Array) -> list:
    """Booleans, none null, as a list."""
    return values.to_numpy(zero_copy_only=False).tolist()


def _strings(words: pa.Array) -> list[str]:
    """Words without a space as a list."""
    joined = pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), " ")[0].as_py()
    return joined.split(" ") if len(words) else []


def coder(path: str) -> WordCoder:
    """The coder of this Python process, which outlives a task."""
    kept = sys.modules.setdefault("_fieldtally_coders", types.ModuleType("_fieldtally_coders"))
    if path not in kept.__dict__:
        setattr(kept, path, WordCoder(path))
    return kept.__dict__[path]


def write_records(docs: DataFrame, tokenizer: str, folder: str, end_id: int | None = 0) -> None:
    """Encode `docs(doc_id, text)` and write the records to the new `folder`/records, then the index.

    Records are in ascending order of doc_id over all shards (null first; ties by text hash,
    then text) and shards in order of their names. `end_id` is appended to each document. Null
    texts are empty, repeated rows are repeated records, an empty table makes no records;
    further columns are left out. The shards are written by Spark's text sink, whose
    line end is the last byte of a record, so that any file system Spark writes to will do.

    The index, a Parquet table beside the records, is made by reading them: shard, record,
    doc_id, offset and length in bytes, n_tokens, ids_crc32, start (ids of all records before).
    """
    text = text_or_empty()
    table = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    order = [F.col("doc_id"), F.xxhash64("text")]
    ranged = table.repartitionByRange(*order).sortWithinPartitions(*order, "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = coder(tokenizer)
        tail = b"" if end_id is None else int(end_id).to_bytes(words.width, "little")
        for batch in batches:
            docs = iter(batch.column(0).to_pylist())
            for some in words.encode_all(batch.column(1)):
                out: list[bytes] = []
                for ids, doc in zip(some, docs):
                    ids += tail
                    head = struct.pack(_HEAD, doc or 0, doc is not None, words.width, len(ids) // words.width)
                    out.append(frame(head + ids)[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    records = ranged.mapInArrow(encode, "record binary").select(F.col("record").cast("string").alias("value"))
    records.write.option("compression", "none").option("lineSep", "\n").option(
        "maxRecordsPerFile", SHARD_RECORDS).text(f"{folder}/records")
    _index(docs.sparkSession, folder).write.parquet(f"{folder}/index")


def read_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """Every record as written: shard, record, doc_id, offset, length, n_tokens, ids (binary, 4 bytes each)."""
    return _read(spark, folder, "ids binary", lambda ids: ids.tobytes(), pa.binary())


def _read(spark: SparkSession, folder: str, column: str, value, kind: pa.DataType) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{folder}/records").select(
        "path", "content")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["shard", "record", "doc_id", "offset", "length", "n_tokens", column.split()[0]]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), kind]
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                shard = re.search(r"part-\d+", path.as_py())[0] + re.search(r"(-c\d+)?\.\w+$", path.as_py())[0]
                rows: list[tuple] = []
                for i, (at, payload) in enumerate(frames(memoryview(content.as_buffer()))):
                    doc, named, width, n = struct.unpack_from(_HEAD, payload)
                    ids = np.frombuffer(payload, dtype=f"<u{width}", count=n, offset=struct.calcsize(_HEAD)).astype("<u4")
                    rows.append((shard, i, doc if named else None, at, len(payload), n, value(ids)))
                    if len(rows) == 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return files.mapInArrow(parse, f"shard string, record long, doc_id long, offset long, length long, n_tokens long, {column}")


def _index(spark: SparkSession, folder: str) -> DataFrame:
    records = _read(spark, folder, "ids_crc32 long", lambda ids: zlib.crc32(ids.tobytes()), pa.int64())
    before = W.partitionBy("shard").orderBy("record").rowsBetween(W.unboundedPreceding, -1)
    return records.withColumn("start_in_shard", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """The offset index with the number of ids before each record (one row per shard is summed in a row)."""
    index = spark.read.parquet(f"{folder}/index")
    shards = index.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    return index.join(shards, "shard").select(
        "shard", "record", "doc_id", "offset", "length", "n_tokens", "ids_crc32",
        (F.col("ahead") + F.col("start_in_shard")).alias("start"))


def encoded(docs: DataFrame, tokenizer: str, end_id: int | None = 0) -> DataFrame:
    """Write `docs` to a new folder of the shared place and return its index, read back from the files."""
    spark = docs.sparkSession
    folder = new_folder(spark, "token-records")
    write_records(docs, tokenizer, folder, end_id)
    return read_index(spark, folder)
