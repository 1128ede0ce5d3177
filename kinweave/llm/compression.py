"""Quality classifier by compression: dictionaries trained on good and on bad labelled texts compress a text, in blocks; the
difference of the compressed sizes over the size of the text, calibrated by logistic regression, is the score.

The model is fitted on the driver on a bounded sample (`rows` labelled documents of at most `max_bytes` each, by the hash
of their ids): one half trains the dictionaries, the other calibrates. It is two dictionaries of `size` bytes and two
weights, so what is sent to the executors has a fixed size. Scoring is one pass without a shuffle.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_fold, labelled_sample, logistic, map_texts, release, sigmoid


@dataclass(frozen=True)
class Settings:
    rows: int = 6000
    max_bytes: int = 1 << 15
    size: int = 1 << 16
    block: int = 2048
    level: int = 3


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]  # slope and intercept
    settings: Settings

    def scorer(self):
        """A function from texts to scores; it builds the compressors once, where it runs."""
        state: list = []

        def score(texts: list[str]) -> np.ndarray:
            if not state:
                state.extend(_compressor(d, self.settings) for d in (self.good, self.bad))
            slope, intercept = self.weights
            return sigmoid(np.array([difference(t, *state, self.settings.block) for t in texts]) * slope + intercept)

        return score


def _dictionary(texts: list[bytes], size: int) -> bytes:
    """A trained dictionary; where there is too little text to train one, the text itself."""
    try:
        return zstandard.train_dictionary(size, texts).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(texts)[-size:]


def _compressor(dictionary: bytes, s: Settings):
    if not dictionary:
        return zstandard.ZstdCompressor(level=s.level, write_content_size=False)
    data = zstandard.ZstdCompressionDict(dictionary)
    data.precompute_compress(level=s.level)
    return zstandard.ZstdCompressor(dict_data=data, write_content_size=False, write_dict_id=False)


def difference(text: str, good, bad, block: int) -> float:
    """(bytes with the bad dictionary - bytes with the good one) / bytes of the text, over all its blocks; 0 for an empty text."""
    data, by_good, by_bad = text.encode(), 0, 0
    for i in range(0, len(data), block):
        part = data[i : i + block]
        by_good += len(good.compress(part))
        by_bad += len(bad.compress(part))
    return (by_bad - by_good) / max(1, len(data))


def fit(sample: list[tuple[str, int]], settings: Settings = Settings()) -> Model:
    """Without texts of both labels the score is the share of label 1 (0.5 without any)."""
    build, check = sample[::2], sample[1::2]
    sets = [[t.encode() for t, y in build if y == label and t] for label in (1, 0)]
    if not all(sets) or len({y for _, y in check}) < 2:
        share = (sum(y for _, y in sample) + 0.5) / (len(sample) + 1)
        return Model(b"", b"", (0.0, float(np.log(share / (1 - share)))), settings)
    model = Model(*[_dictionary(x, settings.size) for x in sets], (0.0, 0.0), settings)
    compressors = [_compressor(d, settings) for d in (model.good, model.bad)]
    x = np.array([difference(t, *compressors, settings.block) for t, _ in check])
    spread = float(x.std()) or 1.0
    slope, intercept = logistic(x[:, None] / spread, np.array([y for _, y in check], float))
    return Model(model.good, model.bad, (float(slope / spread), float(intercept)), settings)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", mod: int = 5, held: int = 0, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fits on labelled documents whose fold isn't the held-out one. Of repeated label rows the greatest label counts."""
    return fit(labelled_sample(docs, labels, label, crc_fold(F.col(id_col), mod) != held, settings.rows, settings.max_bytes, id_col, text_col), settings)


def score_quality(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score in [0, 1] of every row's whole text; null counts as empty, and an empty text gets the score of no difference.

    Null ids and repeated rows stay, an empty table gives an empty result, equal texts get equal scores. Other columns aren't read.
    """
    score = model.scorer()
    return map_texts(docs, [id_col], text_col, "score double", lambda texts: {"score": pa.array(score(texts), pa.float64())})


def keep_good(docs: DataFrame, model: Model, least: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows whose text scores `least` or more, with all their columns unchanged. Null counts as empty; null ids, repeated rows and an empty table pass through as they are."""
    score = model.scorer()

    @F.pandas_udf("boolean")
    def good(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        release("")
        for texts in batches:
            yield pd.Series(score(texts.tolist()) >= least)
        release("")

    return docs.where(good(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))


def op9_quality_compression(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score_quality(docs, train(docs, labels))
    return scored.select("doc_id", (crc_fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
