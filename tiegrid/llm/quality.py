"""Quality by compression: which of two zstandard dictionaries fits a text better.

One dictionary is trained on pieces of labelled good texts, the other on pieces
of bad ones. A text is compressed piece by piece with each, so that the
dictionary counts all the way through; the difference of the two sizes over the
size of the text is the feature. A logistic curve over it and the logarithm of
the length (a frame costs the same whatever a text's length), fitted on other
labelled texts, turns it into the probability of a good label.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiegrid.llm.common import map_texts, materialize, text_bytes, worker_object

#: At most so many labelled ids are learned from, taken by their hash.
MAX_LABELLED = 6000
#: Bytes of a piece of text and of a dictionary, and pieces that a dictionary is trained on at most.
PIECE, DICTIONARY, MAX_PIECES = 1024, 110_000, 8000
LEVEL = 5
THRESHOLD = 0.7


def pieces(text: bytes) -> list[bytes]:
    return [text[at : at + PIECE] for at in range(0, len(text), PIECE)]


def dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A dictionary trained on the samples; too few of them to train on are its content as they are."""
    try:
        return zstandard.train_dictionary(min(DICTIONARY, sum(map(len, samples)) // 4), samples, level=LEVEL)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"\n".join(samples)[-DICTIONARY:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class Sizes:
    """Compressed sizes of texts under two dictionaries, given as bytes and whether they were trained."""

    def __init__(self, good: tuple[bytes, bool], bad: tuple[bytes, bool]) -> None:
        self.compressors = []
        for content, trained in (good, bad):
            data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(level=LEVEL)
            params = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=data, compression_params=params))

    def difference(self, text: bytes) -> float:
        """(bad - good) / length; 0 for an empty text."""
        good, bad = (sum(len(c.compress(p)) for p in pieces(text)) for c in self.compressors)
        return (bad - good) / max(1, len(text))

    def features(self, texts: list[bytes]) -> np.ndarray:
        return np.array([[self.difference(t), np.log(max(1, len(t)))] for t in texts]).reshape(-1, 2)


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Weights of a bias and the columns, by Newton steps with a slight ridge."""
    columns = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(columns.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(columns @ w, -30, 30)))
        h = columns.T @ (columns * (p * (1 - p))[:, None]) + 1e-2 * np.eye(len(w))
        w += np.linalg.solve(h, columns.T @ (y - p) - 1e-2 * w)
    return w


def labelled_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int) -> DataFrame:
    """(text, label, half) of at most ``most`` labelled ids; rows with a null label or text are left out.

    An id has the highest of its labels and the first of its texts in their
    order. Equal texts lie in one half.
    """
    usable = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    chosen = usable.groupBy(id_col).agg(F.max(label_col).cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64(id_col), id_col).limit(most)
    texts = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col), F.col(text_col).alias("text"))
    found = texts.join(F.broadcast(chosen), id_col).groupBy(id_col, "label").agg(F.min("text").alias("text"))
    return found.select(F.col("text").cast("binary").alias("text"), "label", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int").alias("half"))


def learn(rows: DataFrame) -> dict:
    """Dictionaries from one half of the labelled texts, the curve from the other half, so that no text meets its own copy.

    The driver gets MAX_PIECES pieces for a dictionary at most, and two numbers
    of each text that the curve is fitted on.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in text_bytes(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(pieces(text), pa.binary())], names=["piece"])

    def sample(label: int) -> list[bytes]:
        texts = rows.filter((F.col("half") == 0) & (F.col("label") == label)).select("text")
        found = texts.mapInArrow(cut, "piece binary").orderBy(F.xxhash64("piece"), "piece").limit(MAX_PIECES).collect()
        return [bytes(r[0]) for r in found]

    samples = {label: sample(label) for label in (1, 0)}
    share = rows.agg(F.try_divide(F.sum("label") + 1.0, F.count(F.lit(1)) + 2.0)).first()[0]
    weights = [float(np.log(share / (1 - share))) if share else 0.0, 0.0, 0.0]
    if not all(samples.values()):
        return {"contents": None, "weights": weights, "centre": [0.0, 0.0], "scale": [1.0, 1.0]}
    made = [dictionary(samples[label]) for label in (1, 0)]
    contents = [(d.as_bytes(), d.dict_id() != 0) for d in made]
    shared = rows.sparkSession.sparkContext.broadcast(contents)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(*shared.value)
        for batch in batches:
            x = sizes.features(text_bytes(batch.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1]), batch.column(1)], names=["x", "n", "label"])

    found = rows.filter("half = 1").select("text", "label").mapInArrow(measure, "x double, n double, label int").orderBy("x", "n", "label").toPandas()
    shared.destroy()
    x, y = found[["x", "n"]].to_numpy(float), found["label"].to_numpy(float)
    if not len(x):
        return {"contents": None, "weights": weights, "centre": [0.0, 0.0], "scale": [1.0, 1.0]}
    centre, scale = x.mean(0), np.where(x.std(0) > 0, x.std(0), 1.0)
    return {"contents": contents, "weights": logistic((x - centre) / scale, y).tolist(), "centre": centre.tolist(), "scale": scale.tolist()}


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    folds: int = 4,
    held: int = 2,
    most: int = MAX_LABELLED,
) -> DataFrame:
    """(id, held_out, score, predicted) for every row of ``docs``.

    Labels of rows whose crc32 of the id as text is ``held`` modulo ``folds``
    are never read. score is the calibrated probability of label 1 for the
    whole text; predicted is 1 from THRESHOLD on. Of the other labelled ids
    ``most`` are learned from. An empty or null text scores as a text of one
    byte that both dictionaries fit alike. Repeated rows each give their row.
    Without labels of both kinds the score is the smoothed share of good ones.
    An empty table gives an empty result.
    """

    def held_out(column):
        return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == held

    known = labelled_rows(docs, labels.filter(~held_out(F.col(id_col))), id_col, text_col, label_col, most)
    model = learn(materialize(known, "quality-texts"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(texts: list[bytes]) -> list[pa.Array]:
        m = shared.value
        sizes = worker_object("quality", m["contents"], lambda: Sizes(*m["contents"])) if m["contents"] else None
        x = sizes.features(texts) if sizes else np.zeros((len(texts), 2))
        z = m["weights"][0] + (x - m["centre"]) / m["scale"] @ np.array(m["weights"][1:])
        return [pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))))]

    scored = map_texts(docs, rows, "score double", id_col, text_col, "quality")
    return scored.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
