"""Language identification by prediction by partial matching over bytes.

For each language the counts of bytes after contexts of 0 to 3 bytes are gathered from a bounded sample of labelled
texts and frozen. A byte's probability is its share in the longest context that was seen, count / (total + kinds); a byte
that was not seen there costs the escape, kinds / (total + kinds), and is looked for in the next shorter context among
the bytes that the longer one has not excluded; below order 0 the 256 bytes are equally likely. The code length of a text is
the sum of -log2 of these probabilities, and the language with the shortest code (with -log2 of its share
in the training rows added) is predicted.

Contexts have three bytes at most, so all probabilities fit into one table from (context, byte) to code lengths and a text
is scored by one lookup a byte; contexts of three bytes that no sample holds take the row of their last two bytes.

The sample is about `per_language` whole texts of each language, picked by a hash.

Repeated rows are predicted alike. Of no documents there are no rows. Rows without text, or whose text has no letter (\\p{L}), are `und` with score 0. Without any labelled text, all are.
Ties of code lengths go to the language that sorts first. Texts are scored whole, in runs of bounded size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm import common

#: Of each language: sampled documents.
PER_LANGUAGE = 300
#: Bytes scored at once.
RUN = 1 << 21


class Ppm:
    """Frozen statistics of all languages. samples: texts by language."""

    def __init__(self, samples: dict[str, list[bytes]], shares: dict[str, float]):
        self.languages = sorted(samples)
        self.prior = np.array([-np.log2(max(shares[x], 1e-9)) for x in self.languages])
        seen = np.zeros(256, bool)
        for texts in samples.values():
            for t in texts:
                seen[np.frombuffer(t, np.uint8)] = True
        #: Symbol 0 is what comes before a text, and any byte that no sample has.
        self.symbol = np.where(seen, np.cumsum(seen), 0).astype(np.int32)
        self.a = a = int(seen.sum()) + 1
        self.counts = []
        for x in self.languages:
            grams: np.ndarray = np.empty(0, np.int64)
            parts = []
            for t in samples[x]:
                s = np.concatenate([np.zeros(3, np.int64), self.symbol[np.frombuffer(t, np.uint8)]])
                parts.append(((s[:-3] * a + s[1:-2]) * a + s[2:-1]) * a + s[3:])
            grams = np.concatenate(parts) if parts else grams
            self.counts.append(np.unique(grams, return_counts=True))
        self.code = None

    def build(self) -> None:
        """The table of code lengths, from the counts; made where it is used."""
        a = self.a
        deep = np.unique(np.concatenate([g // a for g, _ in self.counts]))
        self.row = np.tile(np.arange(a * a, dtype=np.int32), a)
        self.row[deep] = a * a + np.arange(len(deep), dtype=np.int32)
        self.code = np.empty(((a * a + len(deep)) * a, len(self.languages)), np.float32)
        for k, (grams, n) in enumerate(self.counts):
            symbol = grams % a
            below = np.full(a, 1 / 256)
            below = self.blend(np.bincount(symbol, n, a)[None], below[None])[0]
            one = np.bincount(grams % a**2, n, a**2).reshape(a, a)
            p1 = self.blend(one, np.broadcast_to(below, (a, a)))
            two = np.bincount(grams % a**3, n, a**3).reshape(a * a, a)
            p2 = self.blend(two, np.tile(p1, (a, 1)))
            three = np.bincount(np.searchsorted(deep, grams // a) * a + symbol, n, len(deep) * a).reshape(-1, a)
            p3 = self.blend(three, p2[deep % a**2])
            self.code[:, k] = -np.log2(np.concatenate([p2, p3]).ravel())

    @staticmethod
    def blend(count: np.ndarray, below: np.ndarray) -> np.ndarray:
        """A row for each context: shares of what was seen, and the escape over the rest of the order below."""
        n, kinds = count.sum(1, keepdims=True), (count > 0).sum(1, keepdims=True)
        rest = np.maximum(1 - np.where(count > 0, below, 0).sum(1, keepdims=True), 1e-12)
        with np.errstate(invalid="ignore", divide="ignore"):
            made = np.where(count > 0, count / (n + kinds), kinds / (n + kinds) * below / rest)
        return np.where(n > 0, made, below)

    def bits(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Code lengths, languages in columns, of the texts that lie one after another in data."""
        if self.code is None:
            self.build()
        a, total = self.a, np.zeros((len(ends) - 1, len(self.languages)))
        full = np.flatnonzero(np.diff(ends))
        starts = ends[full]
        for at in range(int(ends[0]), int(ends[-1]), RUN):
            to = min(at + RUN, int(ends[-1]))
            s = self.symbol[data[max(at - 3, int(ends[0])) : to]]
            s = np.concatenate([np.zeros(3 - min(3, at - int(ends[0])), np.int32), s])
            # Texts that begin in this run, or up to two bytes before it, see nothing of the text before them.
            begun = starts[(starts > at - 3) & (starts < to)]
            before = [s[2:-1].copy(), s[1:-2].copy(), s[:-3].copy()]
            for back in range(3):  # the byte that stands back + 1 places before
                for j in range(back + 1):
                    hit = begun + j - at
                    before[back][hit[(hit >= 0) & (hit < to - at)]] = 0
            row = self.row[(before[2] * a + before[1]) * a + before[0]]
            got = self.code[row.astype(np.int64) * a + s[3:]]
            first = int(np.searchsorted(starts, at, "right")) - 1
            last = int(np.searchsorted(starts, to, "left"))
            cut = np.maximum(starts[first:last] - at, 0)
            total[full[first:last]] += np.add.reduceat(got, cut, axis=0, dtype=np.float64)
        return total

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        data, ends = flat_bytes(texts)
        bits = self.bits(data, ends) + self.prior
        best = bits.argmin(1)
        share = np.exp2(bits.min(1, keepdims=True) - bits)
        return [self.languages[k] for k in best], 1 / share.sum(1)


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes and where each ends, without copies; nulls are empty."""
    texts = texts.fill_null("") if texts.null_count else texts
    texts = texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8) if len(texts) else np.empty(0, np.uint8)
    return data, ends


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "lang", key: str | None = None, per_language: int = PER_LANGUAGE) -> Ppm | None:
    """The model of labelled rows; None if there are none. key: a column that tells equal texts apart when rows are picked."""
    rows = labelled.select(F.col(text_col).alias("t"), F.col(label_col).alias("k"), (F.col(key) if key else F.lit(0)).alias("id"))
    counts = {r[0]: r[1] for r in rows.where("k is not null").groupBy("k").count().collect()}
    take = common.bounded_sample(rows, "k", per_language, "t", "id")
    samples: dict[str, list[bytes]] = {}
    for k, text in take.where(F.length("t") > 0).select("k", "t").collect():
        samples.setdefault(k, []).append(text.encode())
    n = sum(counts[k] for k in samples)
    return Ppm({k: sorted(v) for k, v in samples.items()}, {k: counts[k] / n for k in samples}) if samples else None


def identify(docs: DataFrame, model: Ppm | None, text_col: str = "text") -> DataFrame:
    """The rows with lang_pred and score, the share of the predicted language's code in those of all; columns of these names are replaced."""
    letters: Column = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    if model is None:
        return docs.withColumn("lang_pred", F.lit("und")).withColumn("score", F.lit(0.0))
    made = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.Array) -> pa.Array:
        names, share = made.value.predict(batch)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(share, pa.float64())], ["lang_pred", "score"])

    kind = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    got = docs.withColumn("__ppm", F.arrow_udf(run, kind)(F.col(text_col)))
    return got.withColumn("lang_pred", F.when(letters, F.col("__ppm.lang_pred")).otherwise("und")).withColumn("score", F.when(letters, F.col("__ppm.score")).otherwise(0.0)).drop("__ppm")
