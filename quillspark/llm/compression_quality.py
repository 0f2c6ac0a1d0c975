"""Quality by compression: a text is better, the better a dictionary of good texts compresses it.

Two zstandard dictionaries are trained on labelled text, one on good and one on bad documents. A text is cut into blocks
and each block compressed with either dictionary; the feature is the difference of the summed sizes, divided by their
sum. A second feature, the smaller size divided by the text's own bytes, tells text that repeats itself so much that any
dictionary does. A logistic curve over both, fitted on labelled documents that are in neither dictionary and
corrected for the labels' shares, gives the score.

Dictionaries and curve come from a bounded sample: the whole texts of `per_label` documents of each label, picked by a hash of the id.
Scores are of whole texts.

Null texts count as empty. Repeated documents score alike, each with a row; of a sampled id all its texts count. Columns of the documents are carried along,
save that the caller names the score's own. An empty text compresses to nothing; its score is the curve's at a difference and a size of 0.
If a label has no text, every score is the share of good labels (0.5 without labels).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm import common
from quillspark.llm.ppm_language import flat_bytes

PER_LABEL, BLOCK = 1500, 4096
DICTIONARY, LEVEL = 112_640, 3


def dictionary(samples: list[bytes], size: int = DICTIONARY) -> bytes:
    """A trained dictionary, or, where there is too little text to train one, that text."""
    parts = [s[i : i + 1024] for s in samples for i in range(0, len(s), 1024)]
    try:
        return zstandard.train_dictionary(min(size, max(256, sum(map(len, parts)) // 8)), parts).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


class Classifier:
    def __init__(self, good: bytes, bad: bytes, curve: np.ndarray | None = None, otherwise: float = 0.5):
        self.dictionaries, self.curve, self.otherwise, self.by = (good, bad), curve, otherwise, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"by": None}

    def sizes(self, text) -> tuple[int, int]:
        """The text's compressed bytes by either dictionary, without frames' headers."""
        if self.by is None:
            self.by = []
            for d in self.dictionaries:
                made = zstandard.ZstdCompressionDict(d)
                made.precompute_compress(level=LEVEL)
                self.by.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=made, write_content_size=False, write_checksum=False, write_dict_id=False))
            self.none = [len(c.compress(b"")) for c in self.by]
        out = [0, 0]
        for at in range(0, len(text), BLOCK):
            block = text[at : at + BLOCK]
            for k, c in enumerate(self.by):
                out[k] += max(len(c.compress(block)) - self.none[k], 1)
        return out[0], out[1]

    def features(self, text) -> tuple[float, float]:
        good, bad = self.sizes(text)
        return (10 * (bad - good) / (bad + good), min(good, bad) / len(text)) if len(text) else (0.0, 0.0)

    def score(self, text) -> float:
        if self.curve is None:
            return self.otherwise
        return float(1 / (1 + np.exp(-np.clip(np.dot(self.curve[:-1], self.features(text)) + self.curve[-1], -35, 35))))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_label: int = PER_LABEL) -> Classifier:
    """A classifier of the documents that labels name. Labels other than 0 and 1 are left out; where an id has both, 1 holds."""
    named = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__label"))
    counts = {r[0]: r[1] for r in named.groupBy("__label").count().collect()}
    picked = common.bounded_sample(named, "__label", per_label, "__id").groupBy("__id").agg(F.max("__label").alias("__label"))
    # about 2 * per_label ids
    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).join(F.broadcast(picked), "__id")
    got = sorted((r.h, r.l, [r.t.encode()]) for r in rows.select(F.xxhash64("t").alias("h"), F.col("__label").alias("l"), "t").distinct().collect())
    share = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    by = {k: [b for h, label, b in got if label == k] for k in (1, 0)}
    if not all(any(map(any, x)) for x in by.values()):
        return Classifier(b"", b"", None, share)
    halves = {k: ([b for i, b in enumerate(x) if i % 2 == 0] or x, [b for i, b in enumerate(x) if i % 2] or x) for k, x in by.items()}
    made = Classifier(*(dictionary([b for doc in halves[k][0] for b in doc]) for k in (1, 0)))
    x = np.array([made.features(b"".join(doc)) for k in (1, 0) for doc in halves[k][1]])
    y = np.repeat([1.0, 0.0], [len(halves[1][1]), len(halves[0][1])])
    made.curve = common.logistic(x, y)
    made.curve[-1] += np.log(share / (1 - share)) - np.log(y.sum() / (len(y) - y.sum()))
    return made


def score(docs: DataFrame, model: Classifier, text_col: str = "text") -> Column:
    """double, 0 to 1: how likely a text is good."""
    made = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.Array) -> pa.Array:
        data, ends = flat_bytes(batch)
        whole = memoryview(data)
        return pa.array([made.value.score(whole[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.float64())

    return F.arrow_udf(run, T.DoubleType())(F.col(text_col))
