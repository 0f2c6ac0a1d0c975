"""A class-based bigram language model, classes found by exchange.

P(word | word before) = P(class | class before) * P(word | class). Tokens are the words of a text between ASCII white
space, with A-Z in lower case, then one end; the end also stands before the first word and is a class of its own.

Clustering works on units: each word that the training part has COUNTED times or more is a unit; rarer words are units by a hash of
their last two bytes (endings carry inflection, punctuation and language). All words of a unit share a class, and units start in the
class of their ending. Exchange goes in rounds: the units' bigrams lie in shards, and of every unit Spark finds the
class in which it raises the likelihood of the corpus' class bigrams most, all else held (to the first order, which is
close for all but the most frequent units). Those that gain move together, or, where that brings too little, the half of them with
the most gain, and so on while they promise enough; then the ALONE most frequent units are exchanged one by one with exact gains. It ends when a round raises the log
likelihood by less than LEAST for each token. The driver and the workers hold nine bytes for each unit (the word's hash, its class).

Word counts, too, are of the whole corpus and stay distributed. The LOOKUP most frequent words (all words down to a count that no more
words reach) go to the workers as hashes and counts; the others of a text meet their counts in a join on the word, once for each
text and word. Words are told apart by 64-bit hashes there and as units.

Transitions are smoothed by Witten-Bell with the classes' shares below. Emissions are smoothed by absolute discounting: what is freed of a class goes to
all its words and one unseen word by their shares in the base model (add one half), so they sum to one with each class's unseen word.

Null texts count as empty: they have one token, the end. Repeated rows stay and score alike, and so do rows with null ids. Of no documents
there are no rows. Without training rows every score is the base score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm import common
from quillspark.llm.bpe import runs

COUNTED, ENDINGS, CLASSES = 10, 1024, 48
LOOKUP = 1_000_000
#: Tokens whose bigrams are summed at once; counted words, and endings, in a shard; and bigrams in a row of more than one unit.
TOKENS, SHARD, SHARD_ENDINGS, ROW = 1_000_000, 4096, 32, 200_000
#: Units that are exchanged one by one, and the gain in log likelihood for each token below which a round is the last.
ALONE, LEAST = 300, 5e-4


def tokens(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct words of the texts, the number of each token's word, and where each text's end."""
    cut = pc.ascii_split_whitespace(texts.fill_null("").cast(pa.large_string()))
    ends = cut.offsets.to_numpy().astype(np.int64)
    coded = cut.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode()
    number: dict[str, int] = {}
    low = [number.setdefault(w.lower() if w.isascii() else w.encode().lower().decode(), len(number)) for w in coded.dictionary.to_numpy(zero_copy_only=False).tolist()]
    of, ends = np.array(low, np.int64)[coded.indices.to_numpy()], ends[1:] - ends[0]
    if "" in number:  # beside white space at a text's ends
        kept = of != number[""]
        ends, of = np.r_[0, np.cumsum(kept)][ends], of[kept]
    return list(number), of, ends


def hashes_of(words: list[str]) -> np.ndarray:
    """As Spark's xxhash64."""
    return np.array([xxhash.xxh64_intdigest(w, 42) for w in words], np.uint64).view(np.int64)


def unit_of_tail(word: Column) -> Column:
    """The unit of a word that isn't counted, from the first of these on."""
    return (F.xxhash64(F.substring(word.cast("binary"), -2, 2)).bitwiseAND(ENDINGS - 1)).cast("int")


def start_class(ending: np.ndarray, k: int) -> np.ndarray:
    """The class in which units of this ending start."""
    return 1 + ending % (k - 1)


class Sorted:
    """Values by 64-bit hash."""

    def __init__(self, hashes: np.ndarray, values: np.ndarray):
        self.hashes, at = np.unique(hashes, return_index=True)
        self.values = values[at]

    def get(self, hashes: np.ndarray, otherwise: int) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(hashes), otherwise)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.values[at], otherwise)


class Units:
    """Unit of a word: 0 the end, 1.. the counted words in the order of their hashes, then the endings."""

    def __init__(self, hashes: np.ndarray):
        self.known = Sorted(hashes, np.arange(1, len(hashes) + 1))
        self.first = 1 + len(hashes)
        self.n = self.first + ENDINGS

    def of(self, words: list[str], hashes: np.ndarray) -> np.ndarray:
        got = self.known.get(hashes, -1)
        if len(rare := np.flatnonzero(got < 0)):
            got[rare] = self.first + (hashes_of([words[k].encode()[-2:] for k in rare.tolist()]) & (ENDINGS - 1))
        return got


def count_words(docs: DataFrame, text_col: str) -> DataFrame:
    """word, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in runs(batch.column(0)):
                names, of, _ = tokens(part)
                n = np.bincount(of, minlength=len(names))
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in some.tolist()], pa.string()), pa.array(n[some], pa.int64())], ["word", "n"])

    return docs.select(F.col(text_col)).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _summed(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The codes once each, in order, with their sums."""
    order = np.argsort(code, kind="stable")
    code, n = code[order], n[order]
    new = np.flatnonzero(np.r_[True, code[1:] != code[:-1]][: len(code)])
    return code[new], np.add.reduceat(n, new) if len(new) else n


def _chunks(key: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """The columns' bytes by key; keys are in order."""
    new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
    for x, y in zip(new.tolist(), [*new[1:].tolist(), len(key)], strict=True):
        yield int(key[x]), *(c[x:y].tobytes() for c in columns)


def _joined(column: pa.ChunkedArray | pa.Array, dtype=np.int64) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype)


#: Rows of neighbouring units from start on: their bigrams as arrays of 32-bit integers in bytes, those that begin with one of the units (0) and those that end with one (1).
SHARD_ROW = "start int, units int, own0 binary, other0 binary, n0 binary, own1 binary, other1 binary, n1 binary"


def count_bigrams(docs: DataFrame, text_col: str, units: Units) -> DataFrame:
    """Bigrams of units, as SHARD_ROW has them: own is the unit's place in the row, other the other unit, n their count (counts of 2**31 or more are several).

    Bigrams are summed in parts by a hash first, so that a frequent unit's come together only when each is one number. Endings, which have far more
    bigrams than words, lie in smaller shards, and a row ends at ROW bigrams unless it is of one unit: what a task reads at once is bounded.
    """
    spark = docs.sparkSession
    made, size, first = spark.sparkContext.broadcast(units), units.n, units.first
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_held = [], 0

        def rows() -> pa.RecordBatch:
            s = np.concatenate([np.zeros(1, np.int64), *held])
            held.clear()
            code, n = np.unique(s[:-1] * size + s[1:], return_counts=True)
            part = (code * 0x9E3779B97F4A7C1 >> 20) % parts  # wraps
            order = np.argsort(part, kind="stable")
            got = list(zip(*_chunks(part[order], code[order], n[order].astype(np.int64)), strict=True))
            return pa.RecordBatch.from_arrays([pa.array(got[0], pa.int32()), pa.array(got[1], pa.binary()), pa.array(got[2], pa.binary())], ["part", "code", "n"])

        for batch in batches:
            for some in runs(batch.column(0)):
                names, of, ends = tokens(some)
                held.append(np.insert(made.value.of(names, hashes_of(names))[of], ends, 0))
                n_held += len(held[-1])
                if n_held > TOKENS:
                    yield rows()
                    n_held = 0
        if held:
            yield rows()

    def shard_of(u: np.ndarray) -> np.ndarray:
        return np.where(u < first, u // SHARD, first // SHARD + 1 + (u - first) // SHARD_ENDINGS)

    def sides(part: pa.Table) -> pa.Table:
        code, n = _summed(_joined(part.column("code")), _joined(part.column("n")))
        turned = code % size * size + code // size
        order = np.argsort(turned, kind="stable")
        got = [(shard, side, c, k) for side, x, y in ((0, code, n), (1, turned[order], n[order])) for shard, c, k in _chunks(shard_of(x // size), x, y)]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*got, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["shard", "side", "code", "n"])

    def whole(key: tuple, part: pa.Table) -> pa.Table:
        both = []
        for side in (0, 1):
            rows = part.filter(pc.equal(part.column("side"), side))
            code, n = _joined(rows.column("code")), _joined(rows.column("n"))
            order = np.argsort(code)
            code, n = code[order], n[order]
            most = (1 << 31) - 1
            times = np.maximum(-(-n // most), 1)
            again = np.repeat(np.arange(len(n)), times)
            place = np.arange(len(again)) - np.repeat(np.cumsum(times) - times, times)
            both.append((code[again] // size, code[again] % size, np.minimum(n[again] - place * most, most)))
        start = min(int(own[0]) for own, _, _ in both if len(own))
        units = 1 + max(int(own[-1]) for own, _, _ in both if len(own)) - start
        total = np.cumsum(sum(np.bincount(own - start, minlength=units) for own, _, _ in both))
        cuts = [0]
        while cuts[-1] < units:
            cuts.append(max(cuts[-1] + 1, int(np.searchsorted(total, (total[cuts[-1] - 1] if cuts[-1] else 0) + ROW, "right"))))
        got = []
        for a, b in pairwise(cuts):
            got.append([start + a, b - a])
            for own, other, n in both:
                some = slice(*np.searchsorted(own, (start + a, start + b)))
                got[-1] += [x.astype(np.int32).tobytes() for x in (own[some] - start - a, other[some], n[some])]
        return pa.table([pa.array(x, k) for x, k in zip(zip(*got, strict=True), (pa.int32(), pa.int32(), *[pa.binary()] * 6), strict=True)], [x.split()[0] for x in SHARD_ROW.split(", ")])

    summed = docs.select(F.col(text_col)).mapInArrow(run, "part int, code binary, n binary").groupBy("part").applyInArrow(sides, "shard int, side int, code binary, n binary")
    return summed.groupBy("shard").applyInArrow(whole, SHARD_ROW)


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def sweep(order: np.ndarray, full: np.ndarray, of: np.ndarray, right: np.ndarray, left: np.ndarray, m: np.ndarray, least: float) -> None:
    """Move the units of order one by one, in place, until a round gains less than least. full has the bigrams among them; right and left, all of theirs by class."""
    while True:
        gained = 0.0
        for u in order:
            a, s = of[u], float(full[u, u])
            r, l = right[u].copy(), left[u].copy()
            r[a] -= s
            l[a] -= s
            m[a] -= r
            m[:, a] -= l
            m[a, a] -= s
            fm, rows, cols = _f(m), m.sum(1), m.sum(0)
            gain = (_f(m + r[None]) - fm).sum(1) + (_f(m + l[:, None]) - fm).sum(0)
            d = m.diagonal()
            gain += _f(d + r + l + s) + fm.diagonal() - _f(d + r) - _f(d + l)
            gain -= _f(rows + r.sum() + s) - _f(rows) + _f(cols + l.sum() + s) - _f(cols)
            gain[0] = -np.inf
            b = int(gain.argmax())
            if gain[b] <= gain[a] + 1e-6:
                b = a
            m[b] += r
            m[:, b] += l
            m[b, b] += s
            if b != a:
                gained += gain[b] - gain[a]
                of[u] = b
                right[:, a] -= full[:, u]
                right[:, b] += full[:, u]
                left[:, a] -= full[u]
                left[:, b] += full[u]
        if gained <= least:
            break


def likelihood(m: np.ndarray) -> float:
    """Of class bigrams, what depends on the classes."""
    return float(_f(m).sum() - _f(m.sum(0)).sum() - _f(m.sum(1)).sum())


def best_moves(right: np.ndarray, left: np.ndarray, a: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of units with these bigrams by class, and classes a: the class that suits each best, and by how much more than its own, to the first order."""
    log = np.log(m + 1)
    gain = right @ log.T + left @ log
    gain -= right.sum(1, keepdims=True) * np.log(m.sum(1) + 1) + left.sum(1, keepdims=True) * np.log(m.sum(0) + 1)
    gain -= gain[np.arange(len(a)), a][:, None]
    gain[:, 0] = -np.inf
    to = gain.argmax(1)
    return to, gain[np.arange(len(a)), to]


def by_class(own: np.ndarray, other: np.ndarray, n: np.ndarray, of: np.ndarray, k: int, units: int) -> np.ndarray:
    """Of a row's side, each unit's bigrams by the class of the other."""
    return np.bincount(own.astype(np.int64) * k + of[other], n, units * k).reshape(units, k)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """start, units and the arrays of each row, where they lie in the batch."""
    for batch in batches:
        start, units, *arrays = batch.columns
        for i in range(len(start)):
            yield start[i].as_py(), units[i].as_py(), [np.frombuffer(c[i].as_buffer(), np.int32) for c in arrays]


class Shards:
    """The units' bigrams, and what is asked of them."""

    def __init__(self, rows: DataFrame, n: int):
        self.rows, self.n = rows, n

    def table(self, of: np.ndarray, k: int) -> np.ndarray:
        """Class bigrams."""
        made = self.rows.sparkSession.sparkContext.broadcast(of)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            of, m = made.value, np.zeros((k, k))
            for start, units, (own, other, n) in _rows(batches):
                m += np.bincount(of[start : start + units][own].astype(np.int64) * k + of[other], n, k * k).reshape(k, k)
            yield pa.RecordBatch.from_arrays([pa.array([m.tobytes()], pa.binary())], ["m"])

        got = self.rows.select("start", "units", "own0", "other0", "n0").mapInArrow(run, "m binary").collect()  # k * k numbers a task
        made.unpersist()
        return sum((np.frombuffer(r.m).reshape(k, k) for r in got), np.zeros((k, k)))

    def moves(self, of: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The class that suits each unit best, and its gain."""
        made, k = self.rows.sparkSession.sparkContext.broadcast((of, m)), len(m)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            of, m = made.value
            for start, units, sides in _rows(batches):
                right, left = (by_class(*x, of, k, units) for x in (sides[:3], sides[3:]))
                to, gain = best_moves(right, left, of[start : start + units].astype(np.int64), m)
                yield pa.RecordBatch.from_arrays([pa.array([start], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (to.astype(np.uint8), gain.astype(np.float32)))], ["start", "to", "gain"])

        to, gain = of.copy(), np.zeros(self.n, np.float32)
        for r in self.rows.mapInArrow(run, "start int, to binary, gain binary").collect():  # five bytes a unit
            to[r.start : r.start + len(r.to)], gain[r.start : r.start + len(r.to)] = np.frombuffer(r.to, np.uint8), np.frombuffer(r.gain, np.float32)
        made.unpersist()
        gain[0] = 0
        return to, gain

    def alone(self, of: np.ndarray, m: np.ndarray, units: np.ndarray, least: float) -> None:
        """Move these few units one by one; of and m change in place."""
        made, k = self.rows.sparkSession.sparkContext.broadcast((of, np.sort(units))), len(m)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            of, chosen = made.value
            for start, units, sides in _rows(batches):
                own = chosen[slice(*np.searchsorted(chosen, (start, start + units)))] - start
                if len(own):
                    right, left = (by_class(*x, of, k, units)[own] for x in (sides[:3], sides[3:]))
                    u, v, n = sides[:3]
                    both = np.isin(u, own) & np.isin(v, chosen)
                    got = (own.astype(np.int64) + start, right, left, u[both].astype(np.int64) + start, v[both].astype(np.int64), n[both].astype(np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in got], ["units", "r", "l", "u", "v", "n"])

        got = self.rows.mapInArrow(run, "units binary, r binary, l binary, u binary, v binary, n binary").toArrow()  # of ALONE units
        made.unpersist()
        units, u, v, n = (_joined(got.column(c)) for c in ("units", "u", "v", "n"))
        order = np.argsort(units)
        units = units[order]
        right, left = (_joined(got.column(c), np.float64).reshape(-1, k)[order].copy() for c in ("r", "l"))
        full = np.zeros((len(units), len(units)))
        np.add.at(full, (np.searchsorted(units, u), np.searchsorted(units, v)), n)
        its = of[units].astype(np.int64)
        sweep(np.arange(len(units)), full, its, right, left, m, least)
        of[units] = its

    def exchange(self, of: np.ndarray, k: int, often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The classes after exchange from the given ones, and their bigrams. Unit 0 stays. often: units that move alone."""
        of, m = of.copy(), self.table(of, k)
        least, now = LEAST * m.sum(), likelihood(m)
        while True:
            before = now
            to, gain = self.moves(of, m)
            order = np.argsort(-gain, kind="stable")[: np.count_nonzero(gain > 0)]
            while (hoped := float(gain[order].sum())) > least:
                tried = of.copy()
                tried[order] = to[order]
                new = self.table(tried, k)
                if (then := likelihood(new)) - now > least / 2 or then - now > hoped / 4:
                    of, m, now = tried, new, then
                    break
                order = order[: len(order) // 2]
            self.alone(of, m, often, least / 4)
            now = likelihood(m)
            if now - before <= least:
                return of, m


class Model:
    """What a worker needs to score a text: units, classes, transitions, emissions and the most frequent words' counts."""

    def __init__(self, units: Units, of: np.ndarray, m: np.ndarray, kinds: np.ndarray, words: np.ndarray, discount: float, lookup: Sorted, n: int, v: int):
        self.units, self.of, self.lookup, self.discount, self.n, self.v = units, of.astype(np.uint8), lookup, discount, n, v
        k = len(m)
        self.ends = int(m.sum(0)[0])
        share = (m.sum(0) + 0.5) / (m.sum() + 0.5 * k)
        seen = np.maximum((m > 0).sum(1, keepdims=True), 1)
        self.step = np.log10((m + seen * share) / (m.sum(1, keepdims=True) + seen))
        #: By class: tokens, and what the discount frees of it over what its words and an unseen one have of the base model.
        self.total = np.maximum(words, 1e-9)
        base = (words + 0.5 * kinds + 0.5) / (n + 0.5 * (v + 1))
        self.freed = np.where(words > 0, discount * kinds / self.total, 1.0) / base

    def base(self, count):
        """P(a word of this count)."""
        return (count + 0.5) / (self.n + 0.5 * (self.v + 1))

    def emission(self, count, cls):
        """log10 P(word of this count | its class)."""
        return np.log10(np.maximum(count - self.discount, 0) / self.total[cls] + self.freed[cls] * self.base(count))


def fit(train: DataFrame, text_col: str = "text", classes: int = CLASSES) -> tuple[Model | None, DataFrame]:
    """The model, and the counts of all words (word, n). None without training rows."""
    train = train.select(F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    counts = common.written(count_words(train, "t"), "word-counts")
    # How many words have a count: few rows, however many words there are.
    by_count = sorted((r[0], r[1]) for r in counts.groupBy("n").agg(F.count("*")).collect())
    least, above = None, 0
    for n, kinds in reversed(by_count):
        if above + kinds > LOOKUP:
            break
        least, above = n, above + kinds
    hashed = counts.select(F.xxhash64("word").alias("h"), "n", "word")
    top = hashed.where(F.col("n") >= least).select("h", "n").toArrow() if least else None  # LOOKUP rows at most
    lookup = Sorted(top.column("h").to_numpy(), top.column("n").to_numpy()) if least else Sorted(np.empty(0, np.int64), np.empty(0, np.int64))
    own = hashed.where(F.col("n") >= COUNTED).select("h", "n", unit_of_tail(F.col("word")).alias("tail")).toArrow()
    hashes, at = np.unique(own.column("h").to_numpy(), return_index=True)
    often, tail = own.column("n").to_numpy()[at], own.column("tail").to_numpy()[at]
    units = Units(hashes)
    rows = common.written(count_bigrams(train, "t", units), "bigrams")
    k = max(2, min(classes, 1 + len(hashes) + ENDINGS))
    of = np.r_[0, start_class(tail, k), start_class(np.arange(ENDINGS), k)].astype(np.uint8)
    of, m = Shards(rows, units.n).exchange(of, k, 1 + np.lexsort((hashes, -often))[:ALONE])
    if not m.sum():
        return None, counts
    # Words and tokens by class: those that are units, and the rest counted by unit.
    kinds, words = np.zeros(units.n), np.zeros(units.n)
    kinds[1 : units.first], words[1 : units.first] = 1, often
    for r in counts.where(F.col("n") < COUNTED).groupBy(unit_of_tail(F.col("word")).alias("u")).agg(F.count("*").alias("kinds"), F.sum("n").alias("n")).collect():  # ENDINGS rows
        kinds[units.first + r.u], words[units.first + r.u] = r.kinds, r.n
    once, twice = dict(by_count).get(1, 0), dict(by_count).get(2, 0)
    discount = min(max(once / (once + 2 * twice), 0.1), 0.95) if once else 0.5
    return Model(units, of, m, np.bincount(of, kinds, k), np.bincount(of, words, k), discount, lookup, int(m.sum()), sum(x for _, x in by_count) + 1), counts


def score(docs: DataFrame, model: Model | None, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base_score, score: log10 probabilities of the whole text by the smoothed unigrams and by the model."""
    if model is None:
        tokens_ = F.size(F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long") + 1
        none = docs.select(F.col(id_col).alias("id"), tokens_.alias("n_tokens"))
        return none.select("id", "n_tokens", F.lit(0).cast("long").alias("n_known"), F.lit(0).cast("long").alias("train_tokens"), F.lit(0.0).alias("base_score"), F.lit(0.0).alias("score"))
    made = docs.sparkSession.sparkContext.broadcast(model)
    kinds = {"id": pa.int64(), "h": pa.int64(), "copies": pa.int64(), "n_tokens": pa.int64(), "n_known": pa.int64(), "base": pa.float64(), "score": pa.float64(), "word": pa.string(), "class": pa.int32(), "tf": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = made.value
        for batch in batches:
            at = 0
            for part in runs(batch.column(2)):
                ids, texts_h = batch.column(0).slice(at, len(part)), batch.column(1).slice(at, len(part))
                at += len(part)
                names, of, ends = tokens(part)
                hashed = hashes_of(names)
                cls = m.of[m.units.of(names, hashed)].astype(np.int64)
                count = m.lookup.get(hashed, -1)
                tail = count < 0
                base = np.where(tail, 0, np.log10(m.base(np.maximum(count, 0))))
                emission = np.where(tail, 0, m.emission(np.maximum(count, 0), cls))
                # Every text's tokens, then its end; the end before stands before its first token.
                each = np.insert(cls[of], ends, 0)
                step = m.step[np.r_[0, each[:-1]], each]
                texts = np.repeat(np.arange(len(part)), np.diff(np.r_[0, ends]))
                total = lambda x: np.bincount(texts, x[of], len(part))
                starts = np.r_[0, ends[:-1]] + np.arange(len(part))
                n = np.diff(np.r_[0, ends]) + 1
                yield pa.RecordBatch.from_arrays([
                    ids, texts_h, pa.array(np.ones(len(part), np.int64)), pa.array(n), pa.array(total(~tail).astype(np.int64) + 1), pa.array(total(base) + math.log10(m.base(m.ends))),
                    pa.array(total(emission) + np.add.reduceat(step, starts)),
                    # a key that no word is, dealt evenly
                    pa.array([f" {h & 1023}" for h in texts_h.to_pylist()], pa.string()), pa.nulls(len(part), pa.int32()), pa.nulls(len(part), pa.int64()),
                ], list(kinds))
                if not tail.any():
                    continue
                rare = np.flatnonzero(tail[of])
                code, tf = np.unique(texts[rare] * len(names) + of[rare], return_counts=True)
                t, w = pa.array(code // len(names)), code % len(names)
                zero = np.zeros(len(code))
                yield pa.RecordBatch.from_arrays([
                    ids.take(t), texts_h.take(t), *[pa.array(zero.astype(np.int64))] * 3, pa.array(zero), pa.array(zero), pa.array([names[x] for x in w.tolist()], pa.string()), pa.array(cls[w].astype(np.int32)), pa.array(tf.astype(np.int64)),
                ], list(kinds))

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    parts = texts.mapInArrow(run, "id long, h long, copies long, n_tokens long, n_known long, base double, score double, word string, class int, tf long")
    per_class = lambda x: F.array(*[F.lit(float(v)) for v in x])
    least = int(model.lookup.values.min()) if len(model.lookup.values) else 1 << 62
    rare = counts.where(F.col("n") < least).withColumnRenamed("n", "c")
    met = parts.join(rare, "word", "left")
    c, tf, cls = F.coalesce(F.col("c"), F.lit(0)), F.col("tf"), F.col("class")
    base = (c + 0.5) / F.lit(model.n + 0.5 * (model.v + 1))
    emission = F.log10(F.greatest(c - model.discount, F.lit(0.0)) / F.get(per_class(model.total), cls) + F.get(per_class(model.freed), cls) * base)
    sums = met.groupBy("id", "h").agg(
        F.sum("copies").alias("copies"), F.sum("n_tokens").alias("n_tokens"), F.sum(F.col("n_known") + F.when(F.col("c").isNotNull(), tf).otherwise(0)).alias("n_known"),
        F.sum(F.col("base") + F.when(tf.isNotNull(), tf * F.log10(base)).otherwise(0.0)).alias("base"), F.sum(F.col("score") + F.when(tf.isNotNull(), tf * emission).otherwise(0.0)).alias("score"),
    )
    whole = lambda x: (F.col(x) / F.col("copies")).cast("long").alias(x)
    each = sums.withColumn("__row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return each.select("id", whole("n_tokens"), whole("n_known"), F.lit(model.n).cast("long").alias("train_tokens"), (F.col("base") / F.col("copies")).alias("base_score"), (F.col("score") / F.col("copies")).alias("score"))
