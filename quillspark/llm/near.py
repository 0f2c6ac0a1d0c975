"""Near-equal texts: MinHash bands find candidates, full shingle sets decide.

1. Every text gets a MinHash signature of its shingle set, cut into bands. `choose_bands` takes the fewest bands that
   reach the recall wanted at the threshold.
2. Texts that share a band are candidates. Within an Arrow batch, texts with a common band are linked to the least id at
   once and only that one goes on to the shuffle on the band, so a band of very many texts arrives once for each batch.
3. Candidates are joined into candidate classes by distributed union-find.
4. Each class's texts meet once and are compared on their full sets. A large class is split into blocks
   of BLOCK texts or fewer, and each pair of blocks is a group of its own, dealt evenly; within a group, sets are compared by
   matrix products over bounded slices. Pairs are never written: a group gives, for each text, how many it is linked to and the least id it is connected to.
   Where links aren't counted, only texts that aren't connected yet are compared, and of a class of more than FEW texts only those that share a band: chance
   candidates grow with the square of the texts, and join what isn't alike into classes of any size.

Ids are 64-bit hashes of the texts, so equal texts are one. Texts without a shingle have no links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations, pairwise, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import common
from quillspark.llm.components import Forest, components

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
#: Texts in a block: BLOCK at most on average, LEAST at least; between these a class is split into SPREAD blocks, for as many tasks as their pairs.
BLOCK, LEAST, SPREAD = 2048, 256, 24
#: Texts of a class that are all compared where links aren't counted; in a larger one each band's are.
FEW = 2048
#: Bits of a sieve at most.
SIEVE = 1 << 26
#: Groups up to so many texts are compared set by set.
SMALL = 32
COLUMNS = 4096
#: Texts compared with all others of a group at once, and after how many texts that reach few others all that is left is compared so.
SLICE, TRIES = 512, 8
#: Bands of texts in a bucket, about.
IN_BUCKET = 2_000_000
#: Characters of groups whose sets are made together.
TOGETHER = 200_000

Hashes = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


def choose_bands(threshold: float, recall: float, rows: int) -> int:
    """The fewest bands of so many rows that find a pair at the threshold with the probability wanted."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**rows)))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse, modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", int(BASE)), ("down", pow(int(BASE), -1, 1 << 64))):
            step = np.full(size, base, np.uint64)
            step[0] = 1
            _powers[name] = np.cumprod(step, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def spans(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each span [start, end) of the codes that depends on the codes alone, not on where they stand."""
    up, down = powers(len(codes) + 1)
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def word_shingles(n: int = 5) -> Hashes:
    """Runs of n words between white space; a shorter text is one shingle. Hashes of all texts, and where each text's end."""

    def make(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        flat = [" ".join(t.split()) for t in texts]
        codes = np.frombuffer("\n".join(flat).encode(), np.uint8)
        cut = np.flatnonzero((codes == 32) | (codes == 10))
        start, end = np.r_[0, cut + 1], np.r_[cut, len(codes)]
        # a word of no bytes is an empty text
        text = np.concatenate([[0], np.cumsum(codes[cut] == 10)])
        per = np.bincount(text, minlength=len(texts))
        first = np.cumsum(per) - per
        place = np.arange(len(start)) - first[text]
        made = np.where(per[text] >= n, place <= per[text] - n, (place == 0) & (end[first[text] + per[text] - 1] > start))
        at = np.flatnonzero(made)
        last = np.minimum(at + n - 1, (first + per - 1)[text[at]])
        return spans(codes, start[at], end[last]), np.r_[0, np.cumsum(np.bincount(text[at], minlength=len(texts)))]

    return make


def rolling(codes: np.ndarray, n: int) -> np.ndarray:
    """The hash, as spans gives it, of the n codes from each place on. Those of the last n - 1 places mean nothing."""
    part, width, base = codes.astype(np.uint64) + np.uint64(1), 1, int(BASE)
    out, done = np.zeros_like(part), 0
    while True:  # part[i]: the codes from i to i + width, weighted by powers of BASE
        if n & width:
            out[: len(out) - done] += part[done:] * np.uint64(pow(base, done, 1 << 64))
            done += width
        if done == n or width >= len(codes):
            return mix(out + np.uint64(n))
        wider = part.copy()
        wider[:-width] += part[width:] * np.uint64(pow(base, width, 1 << 64))
        part, width = wider, width * 2


def char_shingles(n: int) -> Hashes:
    """Runs of n characters; a shorter text is one shingle."""

    def make(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.array([len(t) for t in texts], np.int64)
        first = np.cumsum(size) - size
        per = np.where(size >= n, size - n + 1, (size > 0).astype(np.int64))
        ends, short = np.r_[0, np.cumsum(per)], np.flatnonzero((size > 0) & (size < n))
        begins = np.ones(len(codes), bool)
        for k in range(1, n):
            begins[(first + size)[size >= k] - k] = False
        begins[first[short]] = True
        out = rolling(codes, n)[begins]
        if len(short):
            out[ends[short]] = spans(codes, first[short], first[short] + size[short])
        return out, ends

    return make


def runs(n_chars: list[int], at_once: int = 100_000) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts with about so many characters."""
    a = total = 0
    for i, n in enumerate(n_chars):
        total += n
        if total >= at_once:
            yield a, i + 1
            a, total = i + 1, 0
    if a < len(n_chars):
        yield a, len(n_chars)


def band_hashes(hashes: np.ndarray, ends: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A row for each text that has shingles (in order), a column for each band."""
    starts = ends[:-1][np.diff(ends) > 0]
    out, short = np.empty((len(starts), bands), np.uint64), (hashes >> np.uint64(32)).astype(np.uint32)
    moved = np.empty_like(short)
    for b in range(bands):
        band = np.full(len(starts), np.uint64(b + 1))
        for r in range(rows):
            # a multiplication by an odd number and an addition permute the hashes
            seed = int(mix(np.array([b * rows + r + 1], np.uint64))[0])
            np.multiply(short, np.uint32(seed >> 32 | 1), out=moved)
            np.add(moved, np.uint32(seed & 0xFFFFFFFF), out=moved)
            band = mix(band * np.uint64(0x100000001B3) + np.minimum.reduceat(moved, starts))
        out[:, b] = band
    return out


def pack(bucket: np.ndarray, band: list[np.ndarray], who: list[np.ndarray], root: list[np.ndarray | None]) -> pa.RecordBatch:
    """A row for each bucket, with the bands' hashes and the ids as bytes; root: what the ids are linked to, if they are."""
    sides = [pa.array([None if x is None else x.tobytes() for x in side], pa.binary()) for side in (band, who, root)]
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), *sides], ["bucket", "band", "who", "root"])


def candidates(texts: DataFrame, hashes: Hashes, bands: int, rows: int, name: str) -> DataFrame:
    """a, b, band: links between the ids of texts (id, text) that share a band; each id's with the least of its batch or of its band. A band's links connect all that share it.

    Bands are dealt to buckets by their upper bits, packed: a batch sends each bucket one row. There are as many buckets as keep one's bands near IN_BUCKET.
    """
    spark = texts.sparkSession
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-texts.count() * bands // IN_BUCKET))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, once = np.unique(batch.column(0).to_numpy(), return_index=True)
            column, key, of = batch.column(1).take(pa.array(once)).to_pylist(), [], []
            for a, b in runs([len(t) for t in column]):
                made, ends = hashes(column[a:b])
                if len(made):
                    key.append(band_hashes(made, ends, bands, rows))
                    of.append(ids[a:b][np.diff(ends) > 0])
            if not key:
                continue
            flat, who = np.concatenate(key).ravel(), np.repeat(np.concatenate(of), bands)
            # Ids ascend, so that of equal bands the first is the least id's.
            order = np.argsort(flat, kind="stable")
            flat, who = flat[order], who[order]
            new = np.r_[True, flat[1:] != flat[:-1]]
            root = who[np.flatnonzero(new)][np.cumsum(new) - 1]
            rest = ~new & (who != root)
            if rest.any():
                yield pack(who[rest][:1] % buckets, [flat[rest]], [who[rest]], [root[rest]])
            flat, who = flat[new], who[new]
            to = ((flat >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            start = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
            yield pack(to[start], np.split(flat, start[1:]), np.split(who, start[1:]), [None] * len(start))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links = lambda a, b, band: pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(band.view(np.int64))], ["a", "b", "band"])
        flat, who = [], []
        for batch in batches:
            for band, ids, root in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                if root is not None:
                    yield links(np.frombuffer(ids, np.int64), np.frombuffer(root, np.int64), np.frombuffer(band, np.uint64))
                else:
                    flat.append(np.frombuffer(band, np.uint64))
                    who.append(np.frombuffer(ids, np.int64))
        if flat:
            flat, who = np.concatenate(flat), np.concatenate(who)
            order = np.argsort(flat)
            flat, who = flat[order], who[order]
            new = np.r_[True, flat[1:] != flat[:-1]]
            least = np.minimum.reduceat(who, np.flatnonzero(new))[np.cumsum(new) - 1]
            yield links(who[who != least], least[who != least], flat[who != least])

    found = texts.select("id", "text").mapInArrow(common.tidy(run), "bucket int, band binary, who binary, root binary")
    return found.repartitionById(buckets, F.col("bucket")).mapInArrow(common.tidy(meet), "a long, b long, band long")


class Compare:
    """Links within groups of texts."""

    def __init__(self, hashes: Hashes, threshold: float):
        self.hashes, self.threshold = hashes, threshold

    def sets(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for a, b in runs([len(t) for t in texts]):
            made, ends = self.hashes(texts[a:b])
            out += [np.unique(made[x:y]) for x, y in pairwise(ends.tolist())]
        return out

    def near(self, common_: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        return (common_ > 0) & (common_ >= self.threshold * (n + m - common_) - 1e-9)

    def links(self, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, counted: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of linked texts, of left and of right, in parts. left is right: every pair, in both orders. Not counted: links enough to connect them."""
        if len(sets) <= SMALL:
            known, label, found = [frozenset(s.tolist()) for s in sets], list(range(len(sets))), []
            for i, j in combinations(left.tolist(), 2) if left is right else product(left.tolist(), right.tolist()):
                if (counted or label[i] != label[j]) and known[i] and self.pair(known[i], known[j]):
                    found += [(i, j), (j, i)] if counted and left is right else [(i, j)]
                    if not counted:
                        was = label[j]
                        label = [label[i] if x == was else x for x in label]
            yield (np.array([x[0] for x in found], np.int64), np.array([x[1] for x in found], np.int64))
            return
        size = np.array([len(s) for s in sets])
        flat, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
        _, column, n = np.unique(flat, return_inverse=True, return_counts=True)
        keep = n[column] > 1
        number = np.cumsum(n > 1) - 1
        column, of = number[column[keep]], of[keep]
        order = np.argsort(column, kind="stable")
        column, of = column[order], of[order]
        place = np.full(len(sets), -1)

        def linked(some: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            total = np.zeros((len(some), len(others)), np.float32)
            for c in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
                a, b = np.searchsorted(column, [c, c + COLUMNS])
                sides = []
                for who in (some, others):
                    place[:] = -1
                    place[who] = np.arange(len(who))
                    p = place[of[a:b]]
                    x = np.zeros((len(who), COLUMNS), np.float32)
                    x[p[p >= 0], column[a:b][p >= 0] - c] = 1
                    sides.append(x)
                total += sides[0] @ sides[1].T
            i, j = np.nonzero(self.near(total, size[some][:, None], size[others][None]))
            i, j = some[i], others[j]
            return i[i != j], j[i != j]

        if counted:
            for at in range(0, len(left), SLICE):
                yield linked(left[at : at + SLICE], right)
            return
        sides = (np.isin(np.arange(len(sets)), left), np.isin(np.arange(len(sets)), right))
        fresh, small = np.ones(len(sets), bool), 0
        # From one text to all that it is linked to and that no link has reached, and on from these; then from the next, until this reaches few.
        while len(sets) > SLICE and small < TRIES and fresh.any():
            reached, before = np.flatnonzero(fresh)[:1], fresh.sum()
            fresh[reached] = False
            while len(reached):
                new = []
                for mine, theirs in (sides, sides[::-1]):
                    some = reached[mine[reached]]
                    for at in range(0, len(some), SLICE):
                        if len(others := np.flatnonzero(fresh & theirs)):
                            i, j = linked(some[at : at + SLICE], others)
                            j, k = np.unique(j, return_index=True)
                            yield i[k], j
                            fresh[j] = False
                            new.append(j)
                reached = np.concatenate(new) if new else np.empty(0, np.int64)
            small += (before - fresh.sum()) * 16 < before
        # What is left has no link to the texts reached, and meets in slices.
        some, others = np.flatnonzero(fresh & sides[0]), np.flatnonzero(fresh & sides[1])
        for at in range(0, len(some), SLICE):
            yield linked(some[at : at + SLICE], others[at:] if left is right else others)

    def pair(self, x: frozenset, y: frozenset) -> bool:
        if min(len(x), len(y)) < self.threshold * max(len(x), len(y)) - 1e-9:
            return False
        n = len(x & y)
        return n > 0 and n >= self.threshold * (len(x) + len(y) - n) - 1e-9

    def group(self, ids: list[int], weights: list[int], block: list[bool], both: bool, sets: list[np.ndarray], counted: bool) -> tuple[list[int], list[int], list[int]]:
        """Linked ids, the least id each is connected to here, and the weight of its partners. both: two blocks meet, and only pairs across them count."""
        side = np.array(block)
        everyone = np.arange(len(ids))
        left, right = (np.flatnonzero(side), np.flatnonzero(~side)) if both else (everyone, everyone)
        weight, total, forest = np.array(weights, np.int64), np.zeros(len(ids), np.int64), Forest()
        for i, j in self.links(sets, left, right, counted):
            np.add.at(total, i, weight[j])
            if both or not counted:
                np.add.at(total, j, weight[i])
            if not len(i):
                continue
            # Of each text's partners here, the first stands for the rest if they are connected already.
            for x, y in zip(i.tolist(), j.tolist(), strict=True) if len(i) <= 4 * len(ids) else self.thin(i, j):
                forest.union(ids[x], ids[y])
        linked = np.flatnonzero(total).tolist()
        return [ids[x] for x in linked], [forest.find(ids[x]) for x in linked], total[linked].tolist()

    @staticmethod
    def thin(i: np.ndarray, j: np.ndarray) -> Iterator[tuple[int, int]]:
        """Links that connect what the given ones connect, but no more than a few for each text: labels spread until they are stable."""
        n = int(max(i.max(), j.max())) + 1
        label = np.arange(n)
        while True:
            new = label.copy()
            np.minimum.at(new, i, label[j])
            np.minimum.at(new, j, label[i])
            new = new[new]
            if (new == label).all():
                break
            label = new
        return zip(np.arange(n).tolist(), label.tolist(), strict=True)


def verify(members: DataFrame, member: DataFrame, hashes: Hashes, threshold: float, counted: bool) -> DataFrame:
    """class, split, id, root, links, from members (class, part, id, weight, text), one row for each class and id, and member, their classes and ids alone.

    An id has a row for each group in which it has a link: in a class that was not split, one. part (false if it isn't there): this is only a part of a class, which counts as split.
    """
    compare = Compare(hashes, threshold)
    part = F.col("part") if "part" in members.columns else F.lit(False)
    tasks = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Counted without the texts, which would else be gathered twice.
    sizes = member.groupBy("class").count().where(F.col("count") > LEAST).select("class", F.least(F.ceil(F.col("count") / LEAST), F.greatest(F.lit(SPREAD), F.ceil(F.col("count") / BLOCK))).cast("int").alias("blocks"))
    placed = members.join(sizes, "class", "left").withColumn("own", F.when(F.col("blocks").isNull(), 0).otherwise(F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")))
    other = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = placed.withColumn("other", other).select(
        "class", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), (F.col("own") <= F.col("other")).alias("left"), (part | F.col("blocks").isNotNull()).alias("split"), "id", "weight", "text"
    )
    # A class's pairs of blocks, numbered, go to one task after another.
    to = F.pmod(F.xxhash64("class") + F.shiftright(F.col("q").cast("long") * (F.col("q") + 1), 1) + F.col("p"), F.lit(tasks).cast("long")).cast("int")
    dealt = met.repartitionById(tasks, to).sortWithinPartitions("class", "p", "q", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, whole, out, waiting = None, [], [], [], 0

        def close() -> None:
            """Compare the groups that wait, their sets made together."""
            sets = compare.sets([r[7] for group in whole for r in group])
            for group in whole:
                own, sets = sets[: len(group)], sets[len(group) :]
                key, p, q, _, split, *_ = group[0]
                got = compare.group([r[5] for r in group], [r[6] for r in group], [r[3] for r in group], p != q, own, counted)
                out.extend((key, split, *x) for x in zip(*got, strict=True))
            whole.clear()

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            out.clear()
            kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["class", "split", "id", "root", "links"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:3] != held:
                    if len(rows) > 1:
                        whole.append(rows)
                        waiting += sum(len(r[7]) for r in rows)
                    held, rows = row[:3], []
                    if waiting > TOGETHER:
                        close()
                        waiting = 0
                rows.append(row)
            if len(out) > 20_000:
                yield flush()
        if len(rows) > 1:
            whole.append(rows)
        close()
        if out:
            yield flush()

    return dealt.mapInArrow(common.tidy(run), "class long, split boolean, id long, root long, links long")


def by_band(links: DataFrame, member: DataFrame, n: int) -> DataFrame:
    """class, id, part: the classes of up to FEW texts as they are, and in place of each larger one the texts of each of its bands, without sets that are there already."""
    size = member.groupBy("class").agg(F.count("*").alias("n"))
    large = size.where(F.col("n") > FEW).select("class")
    n_large = large.count()
    if not n_large:
        return member.select("class", "id", F.lit(False).alias("part"))
    large = common.checked_broadcast(large, n_large, 16)
    small = member.join(large, "class", "left_anti").select("class", "id", F.lit(False).alias("part"))
    within = common.checked_broadcast(member.join(large, "class", "left_semi").select(F.col("id").alias("a")), n)
    each = links.join(within, "a", "left_semi").select("band", F.explode(F.array("a", "b")).alias("id")).distinct()
    same = [F.count("*").alias("n"), F.min("id").alias("least"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "id")).alias("y")]
    once = each.groupBy("band").agg(*same).groupBy("n", "least", "x", "y").agg(F.min("band").alias("band")).select("band")
    return small.unionByName(each.join(once, "band", "left_semi").select(F.col("band").alias("class"), "id", F.lit(True).alias("part")))


def sieve(texts: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """The texts whose id is one of n ids, and few others, without a shuffle of the texts: the lower bits of the ids (hashes) make a bitmap of 8 MB at most that is broadcast."""
    size = min(SIEVE, 1 << max(14, (16 * n - 1).bit_length()))
    chunk, word, bit = f"CAST((id & {size - 1}L) >> 14 AS INT)", "CAST((id >> 6) & 255L AS INT)", "CAST(id & 63L AS INT)"
    words = ids.groupBy(F.expr(chunk).alias("__chunk"), F.expr(word).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, {bit})")).alias("bits"))
    rows = words.groupBy("__chunk").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("of"))
    filled = rows.select("__chunk", F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.coalesce(F.col("of")[i], F.lit(0).cast("long"))).alias("__words"))
    return texts.join(F.broadcast(filled), F.expr(f"{chunk} = __chunk AND getbit(__words[{word}], {bit}) = 1"), "left_semi")


def classes(texts: DataFrame, hashes: Hashes, threshold: float, bands: int, rows: int, name: str, counted: bool = True) -> DataFrame:
    """id, root, links of every id that is linked to another; root: the least id of its class. texts: id, text; equal ids are one text, and links count a partner as
    often as it occurs (not counted: links mean nothing)."""
    links = candidates(texts, hashes, bands, rows, name)
    if not counted:
        links = common.written(links, f"{name}-links")
    of = components(links.select("a", "b"), f"{name}-candidates")
    member = common.written(of.select(F.col("a").alias("id"), F.col("b").alias("class")).unionByName(of.select(F.col("b").alias("id"), F.col("b").alias("class")).distinct()), f"{name}-members")
    n = member.count()
    groups = member.select("class", "id", F.lit(False).alias("part"))
    if not counted:
        groups = common.written(by_band(links, member, n), f"{name}-groups")
    # Equal texts are one before they meet, so that a frequent one doesn't gather in a task.
    some = texts.join(F.broadcast(member.select("id")), "id", "left_semi") if common.fits_broadcast(n, 32) else sieve(texts, member.select("id"), n)
    met = some.groupBy("id", "text").agg(F.count("*").alias("weight")).join(common.checked_broadcast(groups, n if counted else groups.count()), "id")
    found = common.written(verify(met.select("class", "part", "id", "weight", "text"), groups, hashes, threshold, counted), f"{name}-verified")
    parts = found.where("split").select(F.col("id").alias("a"), F.col("root").alias("b"))
    joined = components(parts, f"{name}-split")
    whole = found.where("not split").select("id", "root", "links")
    split = found.where("split").groupBy("id").agg(F.sum("links").alias("links")).join(joined.withColumnsRenamed({"a": "id", "b": "root"}), "id", "left")
    return whole.unionByName(split.select("id", F.coalesce("root", "id").alias("root"), "links"))
