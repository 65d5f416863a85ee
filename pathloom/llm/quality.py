"""A quality classifier from compression: two zstandard dictionaries and one calibrated difference.

One dictionary is trained on text labelled good, one on text labelled bad. A text is cut into
chunks of ``chunk`` bytes, each compressed on its own with either dictionary, so that the dictionaries and not
the text's own beginning do the work at any length. (bad size - good size) / bytes is the
normalised difference; a logistic curve fitted on labelled texts that trained no dictionary turns it into a
score from 0 to 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import batches, cut, texts


class Model(NamedTuple):
    """What scoring needs: the dictionaries' bytes, the curve, and the settings they were made with."""

    good: bytes
    bad: bytes
    slope: float
    intercept: float
    chunk: int
    level: int


def held_out(id_col: str = "doc_id"):
    """True for the rows whose labels are never learnt from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def sample(docs: DataFrame, labels: DataFrame, per_class: int = 2000, most_chars: int = 8_000_000) -> dict[int, list[str]]:
    """Whole labelled texts for the fit: of each label at most ``per_class``, and as many as hold ``most_chars`` characters together.

    Rows are taken in the order of their ids' hashes, so the choice is the same at every run; a text that alone exceeds
    ``most_chars`` is passed over. Held-out ids are never taken. An id labelled both ways counts as 0; of an id with several texts
    the shortest counts; null ids, labels other than 0 and 1 and ids without a document teach nothing, and a null text is empty.
    """
    known = labels.where(F.col("quality").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    drawn = known.withColumn("draw", F.xxhash64("doc_id"))
    parts = [drawn.where(F.col("quality") == q).orderBy("draw", "doc_id").limit(per_class) for q in (0, 1)]
    chosen = cut(parts[0].unionByName(parts[1]))
    rows = texts(docs).join(F.broadcast(chosen), "doc_id")  # at most 2 * per_class rows
    sizes = rows.groupBy("quality", "draw", "doc_id").agg(F.min(F.struct(F.length("text").alias("n"))).alias("least")).collect()
    taken, held = [], {0: 0, 1: 0}
    for row in sorted(sizes, key=lambda r: (r["draw"], r["doc_id"])):
        if held[row["quality"]] + row["least"]["n"] <= most_chars:
            held[row["quality"]] += row["least"]["n"]
            taken.append((row["doc_id"], row["least"]["n"]))
    if not taken:
        return {0: [], 1: []}
    wanted = docs.sparkSession.createDataFrame(taken, f"doc_id {chosen.schema['doc_id'].dataType.simpleString()}, n long")
    whole = rows.join(F.broadcast(wanted), "doc_id").where(F.length("text") == F.col("n"))  # as many rows as were taken
    found: dict[int, list[str]] = {0: [], 1: []}
    for row in sorted(whole.groupBy("quality", "draw", "doc_id").agg(F.min("text").alias("text")).collect(), key=lambda r: (r["draw"], r["doc_id"])):
        found[row["quality"]].append(row["text"])
    return found


def chunks(text: bytes, size: int) -> list[bytes]:
    return [text[i : i + size] for i in range(0, len(text), size)]


def dictionary(pieces: list[bytes], size: int) -> bytes:
    """A trained dictionary; too few pieces to train on are used as they are."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, pieces).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[-size:]


def compressors(model: Model) -> list:
    import zstandard

    found = []
    for raw in (model.good, model.bad):
        made = zstandard.ZstdCompressionDict(raw) if raw else None
        if made:
            made.precompute_compress(level=model.level)
        found.append(zstandard.ZstdCompressor(level=model.level, dict_data=made, write_content_size=False, write_checksum=False, write_dict_id=False))
    return found


def difference(text: bytes, pair: list, chunk: int) -> float:
    """The normalised difference of compressed sizes; 0 for an empty text."""
    good, bad = (sum(len(c.compress(piece)) for piece in chunks(text, chunk)) for c in pair)
    return (bad - good) / (len(text) + 16)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 60) -> tuple[float, float]:
    """Slope and intercept of the fitted curve, by Newton's method."""
    design = np.column_stack([x, np.ones_like(x)])
    weights = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ weights, -30, 30)))
        gradient = design.T @ (y - p) - ridge * weights
        curvature = (design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(2)
        step = np.linalg.solve(curvature, gradient)
        weights += step
        if np.abs(step).max() < 1e-9:
            break
    return float(weights[0]), float(weights[1])


def fit(labelled: dict[int, list[str]], size: int = 112_640, chunk: int = 256, level: int = 3) -> Model:
    """Even texts train the dictionaries, all their chunks, and odd ones the curve.

    Without texts of one label nothing can be told apart: the score is then the share of good labels, or
    one half without any labels.
    """
    raw = {q: [t.encode() for t in found] for q, found in labelled.items()}
    n = {q: len(found) for q, found in raw.items()}
    if not n[0] or not n[1]:
        share = (n[1] + 0.5) / (n[0] + n[1] + 1)
        return Model(b"", b"", 0.0, float(np.log(share / (1 - share))), chunk, level)

    made = {q: dictionary([p for t in found[::2] for p in chunks(t, chunk)], size) for q, found in raw.items()}
    model = Model(made[1], made[0], 0.0, 0.0, chunk, level)
    pair = compressors(model)
    held = [(difference(t, pair, chunk), q) for q, found in raw.items() for t in (found[1::2] or found)]
    slope, intercept = logistic(np.array([x for x, _ in held]), np.array([q for _, q in held], float))
    return model._replace(slope=slope, intercept=intercept)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every whole text.

    A null text counts as empty; an empty text has difference 0 and so the curve's value there. Repeated rows are scored
    each for itself, equal texts alike; an empty table gives no rows.
    """
    docs = texts(docs, id_col, text_col)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = compressors(model)
        for batch in batches(parts):
            x = np.array([difference(t.as_py().encode(), pair, model.chunk) for t in batch.column("text")])
            values = 1 / (1 + np.exp(-np.clip(model.slope * x + model.intercept, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values, pa.float64())], names=["doc_id", "score"])

    scored = docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of docs, with all their columns, whose text reaches the threshold.

    Each row is judged for itself by its text alone, so repeated rows go or stay together; a null text is judged as an empty
    one and stays null. An empty table gives no rows.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = compressors(model)
        for batch in batches(parts):
            x = np.array([difference((t.as_py() or "").encode(), pair, model.chunk) for t in batch.column(text_col)])
            yield batch.filter(pa.array(1 / (1 + np.exp(-np.clip(model.slope * x + model.intercept, -30, 30))) >= threshold))

    return docs.mapInArrow(run, docs.schema)
