"""Benchmark passages in documents by the q-gram lemma.

Text is compared as letters and digits in lower case (Latin, Greek and Cyrillic letters; others as they are), everything else being one
space. An item of m characters occurs in a document with at most k edits only if at least m - q + 1 - kq of its q-grams do,
at places whose diagonals (place in the document minus place in the item) differ by k at most. So hits are counted in diagonal
bands of width 2k that overlap by k: one of them holds all hits of an occurrence. Bands that reach the bound are
verified by banded alignment, which ends at the document's borders; nothing else is looked at again. A q-gram that an item repeats more than
OFTEN times counts for every band that any of its places could give: the bound holds the better, and what is counted grows with the text alone.

k is RATE of the item's length, or less where the bound would fall below one. Items with fewer than LEAST characters are too
short to tell from chance when edited: they must stand exactly, between word borders; those with fewer than q, which have no q-gram, must be
a document's whole text. Items without a letter or digit occur nowhere.

Every disjoint occurrence is reported. Null texts have no passages; null item ids are ids like any other. Items repeated with the same id
and text count once; repeated documents have the same passages each. Texts of any length are looked at whole. Without items or documents nothing is found.

The items are broadcast in blocks of ITEM_CHARS characters at most; larger sets take several passes over the documents.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import common

Q, RATE, LEAST = 8, 0.1, 24
ITEM_CHARS = 4_000_000
#: Characters of documents that are looked at together; longer documents are looked at whole.
RUN = 400_000
#: A q-gram that an item repeats more often counts for all bands; hits that are counted together.
OFTEN, HITS = 6, 2_000_000
BITS = 22
#: Regions that are aligned together.
TOGETHER = 256
KNOWN = 0x530
#: What stands at a text's end and before its start, and beyond its end, when it is aligned.
END, PAST = 10, 11
#: What it costs to match a character beyond a text's border: more than any edits.
NEVER = 1 << 20


def _table() -> np.ndarray:
    """For code points below KNOWN: the lower-case letter or digit, or a space."""
    low = [chr(i).lower() for i in range(KNOWN)]
    return np.array([ord(c) if len(c) == 1 and unicodedata.category(c)[0] in "LN" else 32 for c in low], np.uint32)


TABLE = _table()


def plain(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The texts as compared, each ended by END, and where in the joined texts each character stood."""
    codes = np.frombuffer("".join(f"{t}\0" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    known = codes < KNOWN
    made = np.where(known, TABLE[np.where(known, codes, 0)], codes)
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    made[ends] = END
    space = made == 32
    before = np.r_[True, space[:-1] | (made[:-1] == END)]
    at = np.flatnonzero(~(space & before))
    return made[at], at


def grams(codes: np.ndarray) -> np.ndarray:
    """A 32-bit hash of the q-gram at each place."""
    n = len(codes) - Q + 1
    if n <= 0:
        return np.empty(0, np.uint32)
    h = np.zeros(n, np.uint32)
    for k in range(Q):
        h *= np.uint32(0x01000193)
        h += codes[k : k + n]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return h ^ (h >> np.uint32(13))


def align(items: list[np.ndarray], texts: np.ndarray, width: int, anchor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of each item and its row of texts, the least edits between the item and a part of the row, and the diagonal where that part ends.

    The part begins on any of the first `width` diagonals for free, or, with anchors, on the row's own. Rows of many items advance together,
    the longest items first, so that those that are done fall away at the end. END and PAST in a row are never matched, and no part reaches into PAST.
    """
    size = np.array([len(c) for c in items])
    order = np.argsort(-size, kind="stable")
    size, texts = size[order], texts[order]
    codes = np.full((len(items), int(size[0])), END, np.uint32)
    for r, x in enumerate(order.tolist()):
        codes[r, : size[r]] = items[x]
    i = np.arange(width, dtype=np.int32)
    row = np.zeros((len(items), width), np.int32) if anchor is None else np.where(i < anchor[order, None], NEVER, i - anchor[order, None]).astype(np.int32)
    edits, ends = np.empty(len(items), np.int32), np.empty(len(items), np.int64)
    n = len(items)
    for k in range(int(size[0])):
        part = texts[:n, k : k + width]
        step = row + (part != codes[:n, k, None])
        step[part < 32] = NEVER
        np.minimum(step[:, :-1], row[:, 1:] + 1, out=step[:, :-1])
        row = np.minimum.accumulate(step - i, axis=1) + i
        row[part == PAST] = NEVER
        left = int(np.count_nonzero(size > k + 1))
        if left < n:
            done = order[left:n]
            ends[done] = row[left:].argmin(1)
            edits[done] = row[left:].min(1)
            row, n = row[:left], left
    return edits, ends


class Index:
    """Rows by q-gram hash."""

    def __init__(self, hashes: np.ndarray, *columns: np.ndarray):
        order = np.argsort(hashes, kind="stable")
        self.columns = [c[order] for c in columns]
        self.hash, self.first, self.n = np.unique(hashes[order], return_index=True, return_counts=True)

    def rows(self, hashes: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of the hashes: which has a row, and the row's columns."""
        if not len(self.hash):
            return (np.empty(0, np.int64), *(c[:0] for c in self.columns))
        k = np.minimum(np.searchsorted(self.hash, hashes), len(self.hash) - 1)
        hit = np.flatnonzero(self.hash[k] == hashes)
        k = k[hit]
        n = self.n[k]
        row = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[k], n)
        return (np.repeat(hit, n), *(c[row] for c in self.columns))

    def weight(self, hashes: np.ndarray) -> np.ndarray:
        """How many rows each has."""
        if not len(self.hash):
            return np.zeros(len(hashes), np.int64)
        k = np.minimum(np.searchsorted(self.hash, hashes), len(self.hash) - 1)
        return np.where(self.hash[k] == hashes, self.n[k], 0)


Found = tuple[int, int, int, int, int]


class Items:
    """An index of the items' q-grams."""

    def __init__(self, items: list[tuple[int | None, str]]):
        named = [(i, c[:-1] if len(c) and c[-1] == 32 else c) for i, c in ((i, plain([t])[0][:-1]) for i, t in items)]
        kept = [(i, c) for i, c in named if len(c) >= Q]
        self.whole: dict[bytes, list[int | None]] = {}
        for i, c in named:
            if 0 < len(c) < Q:
                self.whole.setdefault(c.tobytes(), []).append(i)
        self.ids, self.codes = [i for i, _ in kept], [c for _, c in kept]
        self.size = size = np.array([len(c) for c in self.codes], np.int64)
        self.edits = np.where(size < LEAST, 0, np.minimum((size * RATE).astype(np.int64), (size - Q) // Q))
        self.bound = size - Q + 1 - self.edits * Q
        self.step = np.maximum(self.edits, 1)
        hashes = [grams(c) for c in self.codes]
        flat, of = np.concatenate([*hashes, np.empty(0, np.uint32)]), np.repeat(np.arange(len(kept)), [len(h) for h in hashes])
        place = np.concatenate([*(np.arange(len(h)) for h in hashes), np.empty(0, np.int64)])
        same = of << 32 | flat
        _, at, back, n = np.unique(same, return_index=True, return_inverse=True, return_counts=True)
        rare = n[back] <= OFTEN
        often = at[n > OFTEN]
        self.rare, self.often = Index(flat[rare], of[rare], place[rare]), Index(flat[often], of[often])
        self.bits = np.zeros(1 << BITS, bool)
        self.bits[flat >> np.uint32(32 - BITS)] = True

    def find(self, texts: list[str]) -> list[tuple[int, int | None, int, int, int]]:
        """(text, item id, start, end, edits) of each disjoint occurrence; places in the text as it is."""
        codes, at = plain(texts)
        ends = np.flatnonzero(codes == END)
        starts = np.r_[0, ends[:-1] + 1]
        base = np.cumsum([0, *(len(t) + 1 for t in texts)])
        found: list[Found] = []
        h = grams(codes)
        hit = np.flatnonzero(self.bits[h >> np.uint32(32 - BITS)])
        weight = self.rare.weight(h[hit]) + (int((self.size / self.step).max(initial=0)) + 3) * self.often.weight(h[hit])
        hit, weight = hit[weight > 0], weight[weight > 0]
        if len(hit):
            reach = int((self.size + 2 * self.step).max())  # a band's hits stand so far apart at most
            a = 0
            total = np.cumsum(weight)
            while a < len(hit):  # bands that begin within a bounded number of hits; the first ones begin before the text
                b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + HITS)))
                upto = hit[b] if b < len(hit) else len(codes)
                some = hit[a : int(np.searchsorted(hit, upto + reach))]
                first = hit[a] if a else -reach
                for item, text, low in self.bands(h, some, starts, first, upto):
                    self.verify(item, text, low, codes, starts, ends, found)
                a = b
        out = []
        best: dict[tuple[int, int], list[Found]] = {}
        for x in sorted(set(found), key=lambda x: (x[4], x[2], x[3])):
            others = best.setdefault(x[:2], [])
            if all(x[3] <= y[2] or x[2] >= y[3] for y in others):
                others.append(x)
        for (t, i), rows in best.items():
            out += [(t, self.ids[i], int(at[a] - base[t]), int(at[b - 1] + 1 - base[t]), n) for _, _, a, b, n in sorted(rows, key=lambda x: x[2])]
        for t in range(len(texts)) if self.whole else ():
            a, b = starts[t], ends[t]
            b -= b > a and codes[b - 1] == 32
            out += [(t, i, int(at[a] - base[t]), int(at[b - 1] + 1 - base[t]), 0) for i in self.whole.get(codes[a:b].tobytes(), ())]
        return out

    def bands(self, h: np.ndarray, hit: np.ndarray, starts: np.ndarray, first: int, upto: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Items, texts and bands (their number times the step is the first diagonal, from the text's start) that reach the bound, of bands that begin in [first, upto)."""
        text = np.searchsorted(starts, hit, "right") - 1
        own = hit - starts[text]
        k, item, place = self.rare.rows(h[hit])
        low = (own[k] - place) // self.step[item]
        # Bands [b * step, (b + 2) * step): a diagonal lies in two.
        k, item, place, low = np.r_[k, k], np.r_[item, item], np.r_[place, place], np.r_[low, low - 1]
        w, of = self.often.rows(h[hit])
        n = -(-self.size[of] // self.step[of]) + 2  # bands that a hit at any place of the item could be in
        more = np.repeat(np.arange(len(w)), n)
        back = np.arange(len(more)) - np.repeat(np.cumsum(n) - n, n)
        w, of = w[more], of[more]
        k, item, low = np.r_[k, w], np.r_[item, of], np.r_[low, own[w] // self.step[of] - back]
        place = np.r_[place, -1 - hit[w]]  # each of these hits counts once
        begin = starts[text[k]] + low * self.step[item]
        mine = (begin >= first) & (begin < upto)
        if not mine.any():
            return
        columns = [item[mine], text[k[mine]], low[mine], place[mine]]
        least = [int(c.min()) for c in columns]
        wide = [int(c.max()) - x + 1 for c, x in zip(columns, least, strict=True)]
        if math.prod(wide) < 1 << 62:
            groups = [columns]
        else:  # numbers too large for one key
            order = np.argsort(columns[0], kind="stable")
            groups = list(zip(*(np.split(c[order], np.flatnonzero(np.diff(columns[0][order])) + 1) for c in columns), strict=True))
        for item, text, low, place in groups:
            key = (((item - least[0]) * wide[1] + (text - least[1])) * wide[2] + (low - least[2])) if len(groups) == 1 else (text - least[1]) * wide[2] + (low - least[2])
            key = np.sort(key * wide[3] + (place - least[3]))
            # Each place of the item counts once in a band.
            key = key[np.r_[True, key[1:] != key[:-1]]] // wide[3]
            new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            n, key = np.diff(np.r_[new, len(key)]), key[new]
            item = key // (wide[1] * wide[2]) + least[0] if len(groups) == 1 else np.full(len(key), item[0])
            enough = n >= self.bound[item]
            item, key = item[enough], key[enough]
            text, low = key // wide[2] % wide[1] + least[1], key % wide[2] + least[2]
            for a in range(0, len(key), TOGETHER):
                yield item[a : a + TOGETHER], text[a : a + TOGETHER], low[a : a + TOGETHER]

    def verify(self, item: np.ndarray, text: np.ndarray, low: np.ndarray, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, found: list[Found]) -> None:
        """Add to found what the bands hold within the items' edits; places in codes."""
        chosen, budget, step = [self.codes[i] for i in item], self.edits[item], self.step[item]
        size, width = self.size[item], 4 * int(step.max()) + 1
        start = starts[text] + low * step - step
        edits, diagonal = align(chosen, around(codes, start, int(size.max()) + width, starts[text], ends[text]), width)
        good = np.flatnonzero(edits <= budget)
        if not len(good):
            return
        # Backwards from where they end, for the places where they begin.
        chosen, budget, size, edits, item, text = [chosen[x][::-1] for x in good], budget[good], size[good], edits[good], item[good], text[good]
        end = start[good] + size + diagonal[good]
        back, width, n = int(budget.max()), 2 * int(budget.max()) + 1, len(codes)
        part = around(codes[::-1], n - end - back, int(size.max()) + width, n - ends[text], n - starts[text])
        _, shift = align(chosen, part, width, np.full(len(good), back))
        begin = end - (size + shift - back)
        alone = (size >= LEAST) | (border(codes, begin) & border(codes, end))
        found += list(zip(text[alone].tolist(), item[alone].tolist(), begin[alone].tolist(), end[alone].tolist(), edits[alone].tolist(), strict=True))


def border(codes: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Whether a word may end before each place: at a space, a text's border, or beside a letter of a script that is taken as it is."""
    a, b = np.where(place > 0, codes[np.maximum(place, 1) - 1], END), codes[np.minimum(place, len(codes) - 1)]
    return (a == 32) | (b == 32) | (a == END) | (b == END) | (a >= KNOWN) | (b >= KNOWN)


def around(codes: np.ndarray, start: np.ndarray, n: int, first: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """A row of n codes from each start; END before first, PAST from upto on."""
    place = start[:, None] + np.arange(n)
    made = codes[np.clip(place, 0, len(codes) - 1)]
    made[place < first[:, None]] = END
    made[place >= upto[:, None]] = PAST
    return made


def find(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """id, text_hash, item_id, start, end, edits: every passage of an item that a document holds."""
    spark = docs.sparkSession
    named = items.where(F.col(item_text).isNotNull()).select(F.col(item_col).cast("long").alias("i"), F.col(item_text).alias("t")).distinct()
    chars = named.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = -(-chars // ITEM_CHARS) or 1
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("t"))
    out = None
    for block in range(blocks):
        some = sorted(((r.i, r.t) for r in named.where(F.pmod(F.xxhash64("t", "i"), F.lit(blocks)) == block).collect()), key=lambda x: (x[0] is not None, x))  # about ITEM_CHARS characters
        made = spark.sparkContext.broadcast(Items(some))

        def run(batches: Iterator[pa.RecordBatch], made=made) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, hashes, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
                a = total = 0
                found = []
                for b in range(1, len(texts) + 1):
                    total += len(texts[b - 1])
                    if total >= RUN or b == len(texts):
                        found += [(ids[a + t], hashes[a + t], *x) for t, *x in made.value.find(texts[a:b])]
                        a, total = b, 0
                cols = list(zip(*found, strict=True)) or [[]] * 6
                kinds = (*[pa.int64()] * 3, *[pa.int32()] * 3)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["id", "text_hash", "item_id", "start", "end", "edits"])

        part = rows.mapInArrow(common.tidy(run), "id long, text_hash long, item_id long, start int, end int, edits int")
        out = part if out is None else out.unionByName(part)
    return out


def flagged(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with __passages, the item_id, start, end and edits of what each holds, by place (empty if nothing)."""
    found = common.written(find(docs, items, id_col, text_col), "passages")
    by = found.distinct().groupBy("id", "text_hash").agg(F.array_sort(F.collect_list(F.struct("start", "end", "item_id", "edits"))).alias("__p"))
    n = found.count()
    by = by.select(F.coalesce("id", F.lit(-(1 << 63))).alias("__i"), F.col("text_hash").alias("__t"), F.transform("__p", lambda p: F.struct(p["item_id"].alias("item_id"), p["start"].alias("start"), p["end"].alias("end"), p["edits"].alias("edits"))).alias("__passages"))
    keyed = docs.withColumn("__id", F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))).withColumn("__th", F.xxhash64(text_col))
    met = keyed.join(common.checked_broadcast(by, n), (F.col("__id") == F.col("__i")) & (F.col("__th") == F.col("__t")), "left")
    return met.withColumn("__passages", F.coalesce("__passages", F.array().cast(by.schema["__passages"].dataType))).drop("__id", "__th", "__i", "__t")
