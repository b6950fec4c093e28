"""Quality classifier from compressed sizes under a good and a bad dictionary."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .calibration import Logistic, fit_logistic
from .common import text_or_empty

# Texts are compressed in pieces of this many bytes: a dictionary says most about the first ones.
PIECE = 512
LEVEL, DICTIONARY_BYTES = 3, 112_640
# Bounds of what is learned from: documents per class for the dictionaries, pieces of each, and
# documents for the calibration. Which ones is decided by a hash of the id.
DICTIONARY_DOCUMENTS, DOCUMENT_PIECES, CALIBRATION_DOCUMENTS = 1500, 8, 20_000
FOLDS = 5


def fold(doc_id: Column) -> Column:
    """The fold of a document; rows of fold 0 are held out. A null id is held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)), F.lit(0))


def _pieces(data: bytes) -> list[bytes]:
    return [data[i:i + PIECE] for i in range(0, len(data), PIECE)] or [b""]


def _dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary, or the samples themselves where they are too few to train on."""
    import zstandard
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


def _measures(texts: Iterator[str], dictionaries: tuple[bytes, bytes]) -> np.ndarray:
    """Per text: difference of the compressed sizes (bad minus good dictionary is negative for bad text) by length,
    its least value over the pieces, and the better size by length."""
    import zstandard
    coders = [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d) if d else None,
                                       write_content_size=False, write_checksum=False, write_dict_id=False)
              for d in dictionaries]
    rows = []
    for text in texts:
        data = text.encode()
        if not data:
            rows.append((np.nan,) * 3)
            continue
        pieces = _pieces(data)
        sizes = np.array([[len(c.compress(p)) for c in coders] for p in pieces], dtype=float)
        lengths = np.array([len(p) for p in pieces], dtype=float)
        gap = sizes[:, 0] - sizes[:, 1]
        rows.append((gap.sum() / len(data), (gap / lengths).min(), sizes.min(axis=1).sum() / len(data)))
    return np.array(rows, dtype=float).reshape(-1, 3)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality") -> tuple[tuple[bytes, bytes], Logistic]:
    """Dictionaries and calibration from labelled rows outside fold 0.

    Folds 2 to 4 give the dictionaries (at most DICTIONARY_DOCUMENTS labels a class and DOCUMENT_PIECES pieces of
    each), fold 1 the calibration (at most CALIBRATION_DOCUMENTS labels). Null labels are left out.
    """
    known = labels.filter(F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    known = known.withColumn("fold", fold(F.col("doc_id")))
    texts = docs.select("doc_id", text_or_empty().alias("text"))

    def some(of: Column, most: int) -> DataFrame:
        """Texts of a bounded number of labels, which are broadcast."""
        chosen = known.filter(of).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        return texts.join(F.broadcast(chosen), "doc_id").select("text", "y")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for y, text in zip(batch["y"], batch["text"]):
                pieces = _pieces(text.encode())
                some = min(len(pieces), DOCUMENT_PIECES)  # spread over the whole text
                out += [(y, pieces[i * len(pieces) // some]) for i in range(some)]
            yield pd.DataFrame(out, columns=["y", "piece"])

    samples: list[list[bytes]] = [[], []]
    for y in (0, 1):
        chosen = some((F.col("fold") > 1) & (F.col("y") == y), DICTIONARY_DOCUMENTS)
        samples[y] = [bytes(r["piece"]) for r in chosen.mapInPandas(cut, "y int, piece binary").collect()]
    dictionaries = (_dictionary(samples[0]), _dictionary(samples[1]))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            m = _measures(iter(batch["text"]), dictionaries)
            yield pd.DataFrame({"y": batch["y"], "a": m[:, 0], "b": m[:, 1], "c": m[:, 2]})

    held = some(F.col("fold") == 1, CALIBRATION_DOCUMENTS)
    table = held.mapInPandas(measure, "y int, a double, b double, c double").toPandas().dropna()
    return dictionaries, fit_logistic(table[["a", "b", "c"]].to_numpy(dtype=float), table["y"].to_numpy(dtype=float))


def score(docs: DataFrame, labels: DataFrame, label: str = "quality", cut: float = 0.3) -> DataFrame:
    """Quality of every whole text: doc_id, held_out, score, predicted.

    The score is a calibrated function of compressed sizes alone: how much smaller the text gets with a dictionary
    of good text than with one of bad text, by length, over all and for the worst piece, and how well it
    compresses at all. An empty or null text gets the share of label 1. `predicted` is 1 from `cut` on. One row per
    row of `docs`, repeated rows too; without labels of either kind the scores say nothing but stay between 0 and 1; an
    empty table gives an empty table; further columns are left out.
    """
    dictionaries, model = train(docs, labels, label)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                scores = model.scores(_measures((t.as_py() for t in part.column("text")), dictionaries))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(scores)],
                                                 names=["doc_id", "held_out", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    table = docs.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), text_or_empty().alias("text"))
    return table.mapInArrow(judge, f"doc_id {kind}, held_out boolean, score double").withColumn(
        "predicted", (F.col("score") >= cut).cast("int"))
