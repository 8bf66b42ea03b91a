"""Quality classifier: hashed word n-gram logistic regression, trained with
follow-the-regularised-leader (FTRL-proximal) updates, scored as sparse dot products.

Features are word unigrams and bigrams of the whole text, hashed into ``2 ** BITS`` places, with
square-rooted counts scaled to unit length; a bigram of a word with itself is one feature.  Words are
split at ASCII white space and A-Z are lower-cased.

Defined cases: null scores like the empty text (the bias alone); repeated rows and null ids stay;
labels that are null don't train; if no labelled row remains every score is the prior 0.5; rows that
tie on text and label are interchangeable; other columns are ignored; the score of a text doesn't depend on its batch.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store, textbuf

#: Places of the hashed feature space, as a power of two.
BITS = 18
#: Most labelled rows that a fit takes; which ones is decided by a hash of the row's key.
TRAIN_ROWS = 20_000
#: Most bytes of features that a fit takes; beyond it rows are left out, last in order first.
TRAIN_BYTES = 128 << 20
#: Updates that a fit aims at; fewer rows are passed over more often, within these bounds.
UPDATES, LEAST_EPOCHS, MOST_EPOCHS = 50_000, 4, 40

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def featurise(offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows of the texts in a buffer: (row bounds, places, values), with unit-length rows."""
    starts, ends, first = textbuf.words(offsets, raw)
    h = textbuf.word_hashes(_LOWER[raw], starts, ends)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    pairs = textbuf.window_hashes(h, 2)
    pairs[h[1:] == h[:-1]] = 0  # a word that follows itself is one feature whatever the word
    whole = row[1:] == row[:-1] if len(row) > 1 else np.empty(0, dtype=bool)
    keys = np.concatenate([row.astype(np.uint64) << np.uint64(BITS) | h >> np.uint64(64 - BITS), (row[:-1].astype(np.uint64) << np.uint64(BITS) | pairs >> np.uint64(64 - BITS))[whole] if len(row) > 1 else np.empty(0, dtype=np.uint64)])
    keys, counts = np.unique(keys, return_counts=True)
    rows = (keys >> np.uint64(BITS)).astype(np.int64)
    places = (keys & np.uint64((1 << BITS) - 1)).astype(np.int64)
    values = np.sqrt(counts.astype(np.float64))
    bounds = np.searchsorted(rows, np.arange(len(first)))
    norms = np.sqrt(np.bincount(rows, counts.astype(np.float64), minlength=len(first) - 1))
    return bounds, places, values / norms[rows]


@dataclass
class FtrlModel:
    """Logistic regression with FTRL-proximal state; ``z`` and ``n`` hold a place for the bias."""

    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 0.1
    l2: float = 0.5

    def __post_init__(self) -> None:
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, places: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[places], self.n[places]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def update(self, places: np.ndarray, values: np.ndarray, label: int) -> None:
        """One example; ``places`` are distinct."""
        places, values = np.append(places, 1 << BITS), np.append(values, 1.0)
        w = self.weights(places)
        p = 1 / (1 + np.exp(-np.clip(values @ w, -35, 35)))
        g = (p - label) * values
        n = self.n[places]
        self.z[places] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[places] = n + g * g


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS) -> DataFrame:
    """Documents with labels to train on: at most ``rows`` labels that aren't held out, by a hash of the
    id, broadcast to the documents' scan; texts aren't shuffled."""
    usable = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).select(id_col, label_col)
    chosen, _ = store.write_table(usable.orderBy(F.xxhash64(id_col), id_col, label_col).limit(rows), "quality-labels")
    return docs.select(id_col, text_col).join(F.broadcast(chosen), id_col)


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "quality", rows: int | None = TRAIN_ROWS, epochs: int | None = None, most_bytes: int = TRAIN_BYTES) -> np.ndarray:
    """Weights (bias last) from at most ``rows`` labelled rows of 0/1 labels (None: all, for rows that are
    bounded already) with at most ``most_bytes`` of features (8 bytes each).

    Features are made where the rows are and written; one task on an executor runs the sequential
    updates over them, in the order of a digest of the text and then the label, so the model is the
    same each time.  The driver gets the weights alone.
    """
    spark = labelled.sparkSession
    store.bounded_batches(spark)
    chosen = labelled.filter(F.col(label_col).isNotNull()).select(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("ord"), F.col(label_col).cast("int").alias("label"), F.col(text_col).alias("__text"))
    if rows is not None:
        chosen = chosen.orderBy("ord", "label").limit(rows)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, offsets, raw in textbuf.slices(batch.column(2)):
                bounds, places, values = featurise(offsets, raw)
                packed = [pa.array([x[a:b].astype(t).tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()) for x, t in ((places, "<i4"), (values, "<f4"))]
                yield pa.RecordBatch.from_arrays([batch.column(0)[first:end], batch.column(1)[first:end], *packed], ["ord", "label", "places", "vals"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def first(rows: list[tuple]) -> list[tuple]:
            """Rows in order, as far as their features are within the bound."""
            rows = sorted(rows)
            sizes = accumulate(len(places) + len(values) for *_, places, values in rows)
            return rows[: bisect.bisect_right(list(sizes), most_bytes)]

        rows, held = [], 0
        for batch in batches:
            rows += zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)
            held += batch.nbytes
            if held > 1.25 * most_bytes:
                rows, held = first(rows), most_bytes
        examples = [(np.frombuffer(places, "<i4"), np.frombuffer(values, "<f4"), label) for _, label, places, values in first(rows)]
        rows.clear()
        model = FtrlModel()
        for _ in range(epochs or min(MOST_EPOCHS, max(LEAST_EPOCHS, UPDATES // max(1, len(examples))))):
            for places, values, label in examples:
                model.update(places, values.astype(np.float64), label)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights().astype("<f8").tobytes()], pa.binary())], ["weights"])

    made, uri = store.write_table(chosen.mapInArrow(make, "ord string, label int, places binary, vals binary"), "quality-features")
    found = made.coalesce(1).mapInArrow(train, "weights binary").collect()
    store.drop(spark, uri)
    return np.frombuffer(found[0].weights, "<f8") if found else FtrlModel().weights()


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col`` and the columns ``keep`` with ``score`` (0 to 1) for every row; one pass, no shuffle.

    The weights, of fixed size whatever the data, go out as one broadcast, which goes with the frame."""
    spark = docs.sparkSession
    store.bounded_batches(spark)
    sent = spark.sparkContext.broadcast(weights)
    names = [id_col, *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for batch in batches:
            for first, end, offsets, raw in textbuf.slices(batch.column(len(names))):
                bounds, places, values = featurise(offsets, raw)
                dots = np.array([w[places[a:b]] @ values[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
                out = 1 / (1 + np.exp(-np.clip(dots + w[-1], -35, 35)))
                yield pa.RecordBatch.from_arrays([*(batch.column(i)[first:end] for i in range(len(names))), pa.array(out, pa.float64())], [*names, "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for n in names for f in docs.schema.fields if f.name == n)
    return docs.select(*names, F.col(text_col).alias("__text")).mapInArrow(run, fields + ", score double")


def held_out(id_col: Column | str = "doc_id") -> Column:
    """Whether a row's label is kept from training: crc32 of the id's text leaves 1 on division by 3."""
    column = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % 3 == 1, F.lit(False))
