"""Byte-level BPE as a streaming transducer with bounded lookahead.

Merges are applied in the order of their list. Take a text's tokens and those of a longer text that begins with it. Before any merge they agree up to
the shorter one's end. A merge (u, v) can move that border only if u ends at it and v begins there in one of the two, and then by the length of u;
whatever begins at the border from then on was built from u. So borders move along chains of merges of rising rank where the next merge's right
part has the last one's u at its left edge. The longest such chain, in bytes, is the list's sufficient lookahead: tokens that end so far before
the end of what was read can't change any more. This holds for lists whose merges each make a new token from parts made before, as trained
lists do; others are refused.

`Encoder` reads a text in parts. It holds the characters whose match of the split pattern is still open, at most HELD of them, and of a longer match
a window of lookahead + BLOCK bytes at most; ids leave as soon as they are settled. Matches that are whole are merged many side by side
in numpy, and remembered by a Python worker within the bounds of `bpe.Pieces`, which also finds a batch's distinct pieces.
`Decoder` turns ids to text and holds the bytes of one unfinished character at most.

Strings of added tokens in a text are those tokens, as the library has it by default; specials=False reads them as ordinary text.
Null texts count as empty; empty texts give no ids. Texts and words may be of any length.
"""

from __future__ import annotations

import codecs
import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm import bpe

#: Characters of an open match that are held before its bytes go to the window; bytes that the window takes beyond the lookahead.
HELD, BLOCK = 64, 1024
#: Matches of so many bytes are merged side by side, longer ones each on its own. Characters of a piece that is cut at once; longer ones are streamed.
SIDE_BY_SIDE, AT_ONCE = 64, 4096
NONE = np.iinfo(np.int32).max
MATCH = regex.compile(public_tokenizers.PATTERN)
#: bpe.LETTERS for Arrow.
SIMPLE = r"\A" + regex.sub(r"\\u(\w{4})", r"\\x{\1}", bpe.LETTERS.pattern) + r"\z"
#: How an open match goes on, by the class of its last character.
LETTERS, NUMBERS, SPACES, OTHERS = (regex.compile(x) for x in (r"\p{L}*", r"\p{N}*", r"\s*", r"[^\s\p{L}\p{N}]*"))


class Shapes(dict):
    """For str.translate: characters that the pattern engine here may class otherwise than the library's, as younger letters, by one of the class there."""

    def __init__(self):
        from tokenizers import pre_tokenizers

        self.split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str

    def __missing__(self, point: int) -> int:
        self[point] = point
        if unicodedata.category(chr(point)) == "Cn":
            first = len(self.split(f"a{chr(point)}1{chr(point)}!"))
            self[point] = ord({4: "é" if len(self.split("a" + chr(point))) == 1 else "§", 3: "²"}.get(first, "　"))
        return self[point]


class Merges:
    """A merge list over bytes, and the tokens that it makes."""

    def __init__(self, pairs: Iterable[tuple[bytes, bytes]], ids: dict[bytes, int]):
        pairs = list(pairs)
        made = {bytes([b]) for b in range(256)} & set(ids)
        for u, v in pairs:
            if u not in made or v not in made or u + v in made:
                raise ValueError(f"not a merge of parts made before to a new token: {u!r} {v!r}")
            made.add(u + v)
        self.pairs, self.ids = pairs, ids
        self.byte_id = np.array([ids.get(bytes([b]), -1) for b in range(256)], np.int32)
        self.made = np.array([ids[u + v] for u, v in pairs] or [0], np.int32)
        self.rank = {(ids[u], ids[v]): r for r, (u, v) in enumerate(pairs)}
        self.width = np.zeros(max(ids.values()) + 1, np.int64)
        self.width[list(ids.values())] = list(map(len, ids))
        self.times = len(self.width)
        keys = np.array([a * self.times + b for a, b in self.rank] or [-1], np.int64)
        order = np.argsort(keys)
        self.keys, self.by_key = keys[order], order.astype(np.int32)
        self.lookahead = self.longest_chain()

    def longest_chain(self) -> int:
        """The sufficient lookahead in bytes."""
        left = {u + v: u for u, v in self.pairs}
        chain: dict[bytes, int] = {}  # by the token that a border has moved past last
        for u, v in self.pairs:
            before, edge = 0, v
            while edge is not None:
                before, edge = max(before, chain.get(edge, 0)), left.get(edge)
            chain[u] = max(chain.get(u, 0), before + len(u))
        return max(chain.values(), default=0)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * self.times + b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.by_key[at], NONE)

    def many(self, words: list[bytes], dtype: np.dtype) -> list[bytes]:
        """The ids of each of many whole matches. Words of one length go in step: a round joins the leftmost pair of least rank in each."""
        out = [b""] * len(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(size, kind="stable")
        for which in np.split(order, np.flatnonzero(np.diff(size[order])) + 1) if words else ():
            if (n := int(size[which[0]])) == 0:
                continue
            if n > SIDE_BY_SIDE:
                for k in which.tolist():
                    out[k] = np.array(self.one(words[k]), dtype).tobytes()
                continue
            ids = self.byte_id[np.frombuffer(b"".join([words[k] for k in which.tolist()]), np.uint8)].reshape(-1, n)
            rank = self.ranks(ids[:, :-1], ids[:, 1:])
            while len(which):
                best = rank.argmin(1) if rank.shape[1] else np.zeros(len(which), np.int64)
                row = np.arange(len(which))
                least = rank[row, best] if rank.shape[1] else np.full(len(which), NONE)
                done = least == NONE
                if done.any():
                    flat, step = ids[done].astype(dtype).tobytes(), ids.shape[1] * np.dtype(dtype).itemsize
                    for i, k in enumerate(which[done].tolist()):
                        out[k] = flat[i * step : i * step + step]
                    go = ~done
                    which, ids, rank, best, least = which[go], ids[go], rank[go], best[go], least[go]
                    row = np.arange(len(which))
                    if not len(which):
                        break
                ids[row, best] = self.made[least]
                stay = np.ones(ids.shape, bool)
                stay[row, best + 1] = False
                ids = ids[stay].reshape(len(which), -1)
                stay = np.ones(rank.shape, bool)
                stay[row, best] = False
                rank = rank[stay].reshape(len(which), -1)
                for some, shift in ((best > 0, 1), (best < rank.shape[1], 0)):
                    r, at = row[some], best[some] - shift
                    rank[r, at] = self.ranks(ids[r, at], ids[r, at + 1])
        return out

    def one(self, data: bytes) -> list[int]:
        """The ids of one match or window, in n log n steps."""
        ids, n = self.byte_id[np.frombuffer(data, np.uint8)].tolist(), len(data)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank, made = self.rank, self.made
        todo = [(r, i) for i in range(n - 1) if (r := rank.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(todo)
        while todo:
            r, i = heapq.heappop(todo)
            j = after[i]
            if ids[i] < 0 or j >= n or rank.get((ids[i], ids[j])) != r:
                continue  # one of the two has gone into another token since
            ids[i], ids[j], after[i] = int(made[r]), -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (r := rank.get((ids[a], ids[b]))) is not None:
                    heapq.heappush(todo, (r, a))
        return [x for x in ids if x >= 0]


class Model:
    """A tokenizer file of the library with byte-level BPE: its merges and its added tokens."""

    def __init__(self, path: str, specials: bool = True):
        with open(path, encoding="utf-8") as f:
            of = json.load(f)
        model, split, added = of["model"], of.get("pre_tokenizer") or {}, of.get("added_tokens") or []
        plain = model["type"] == "BPE" and not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not plain or of.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
            raise ValueError(f"{path} isn't plain byte-level BPE")
        if any(x.get(flag) for x in added for flag in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"{path} has added tokens that take their surroundings with them")
        back = {c: b for b, c in enumerate(bpe.byte_table())}
        ids = {bytes(back[c] for c in word): i for word, i in model["vocab"].items() if all(c in back for c in word)}
        pairs = (x if isinstance(x, list) else x.split(" ") for x in model["merges"])
        self.merges = Merges(((bytes(back[c] for c in u), bytes(back[c] for c in v)) for u, v in pairs), ids)
        self.added = {x["content"]: x["id"] for x in added}
        self.known = {i: token for token, i in ids.items()} | {i: token.encode() for token, i in self.added.items()}
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if specials and self.added else None
        self.shapes = Shapes()

    def shape(self, text: str) -> str:
        return text if text.isascii() else text.translate(self.shapes)

    def cut(self, text: str) -> list[str]:
        """The matches of the split pattern in a whole text without added tokens."""
        return MATCH.findall(text) if text.isascii() else [text[m.start() : m.end()] for m in MATCH.finditer(self.shape(text))]


class Encoder:
    """The transducer: feed() takes the parts of a text, finish() its end; both yield the ids that are settled by then."""

    def __init__(self, model: Model):
        self.model, self.merges = model, model.merges
        self.tail, self.held, self.window, self.run = "", "", bytearray(), None

    def feed(self, part: str) -> Iterator[int]:
        for a in range(0, len(part), AT_ONCE):
            yield from self.read(part[a : a + AT_ONCE], False)

    def finish(self) -> Iterator[int]:
        yield from self.read("", True)

    def read(self, part: str, last: bool) -> Iterator[int]:
        """Ends the text before each added token, and keeps what may be the beginning of one."""
        if self.model.special is None:
            yield from self.match(part, last)
            return
        text, at = self.tail + part, 0
        for m in self.model.special.finditer(text):
            yield from self.match(text[at : m.start()], True)
            yield self.model.added[m.group()]
            at = m.end()
        keep = 0 if last else next((n for n in range(min(len(text) - at, max(map(len, self.model.added)) - 1), 0, -1) if any(x.startswith(text[len(text) - n :]) for x in self.model.added)), 0)
        self.tail = text[len(text) - keep :]
        yield from self.match(text[at : len(text) - keep], last)

    def match(self, part: str, last: bool) -> Iterator[int]:
        text = self.held + part
        shape, n, at = self.model.shape(text), len(text), 0
        if self.run is not None:
            end = self.run.match(shape).end()
            spaces = self.run is SPACES
            if end == n and not last:
                # the last space belongs to what follows
                at = n - 1 if spaces and n else n
                yield from self.push(text[:at])
                self.held = text[at:]
                return
            at = max(end - 1, 0) if spaces and end < n else end
            yield from self.push(text[:at])
            yield from self.close()
        words = []
        for m in MATCH.finditer(shape, at):
            # a match at the end may go on; an apostrophe near it may begin a contraction
            if not last and (m.end() == n or m.start() + 3 > n):
                break
            words.append(text[m.start() : m.end()].encode())
            at = m.end()
        for ids in self.merges.many(words, np.dtype("<u4")):
            yield from np.frombuffer(ids, "<u4").tolist()
        self.held = text[at:]
        if n - at > HELD:
            self.run = next(x for x in (LETTERS, NUMBERS, SPACES, OTHERS) if x.fullmatch(shape, n - 1))
            keep = self.run is SPACES
            yield from self.push(text[at : n - keep])
            self.held = text[n - keep :]

    def push(self, part: str) -> Iterator[int]:
        """More of the open match."""
        data = part.encode()
        for a in range(0, len(data), BLOCK):
            self.window += data[a : a + BLOCK]
            if len(self.window) >= self.merges.lookahead + BLOCK:
                ids = self.merges.one(bytes(self.window))
                ends = np.cumsum(self.merges.width[ids])
                n = int(np.searchsorted(ends, len(self.window) - self.merges.lookahead, "right"))
                yield from ids[:n]
                if n:
                    del self.window[: int(ends[n - 1])]

    def close(self) -> Iterator[int]:
        """The open match ends."""
        yield from self.merges.one(bytes(self.window))
        self.window.clear()
        self.run = None


class Decoder:
    """Bytes to text, one state for each number of bytes that a begun character still lacks. Bytes that are no UTF-8 become U+FFFD."""

    def __init__(self, model: Model):
        self.known, self.state = model.known, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return "".join(self.state.decode(self.known[i]) for i in ids)

    def finish(self) -> str:
        return self.state.decode(b"", True)


class Streamed(bpe.Pieces):
    """Ids of texts through a bounded store, which the transducer fills.

    Most pieces of a corpus are rare, and a word stands in many of them. So words, marks and pieces that the transducer cuts are kept, while a run's pieces
    are taken apart by Arrow and put together by numpy, numbered anew in each run.
    """

    def __init__(self, model: Model, dtype: str = "<u4", kept: int | None = None):
        self.model, self.dtype, self.kept = model, np.dtype(dtype), kept
        self.forget()

    def forget(self) -> None:
        super().forget()
        self.matches: dict[str, bytes] = {}
        #: Numbers of words among all that is kept; 0 is nothing.
        self.words: dict[str, int] = {}
        self.made = bpe.Joined([b""])

    def keep(self, names: list[str], ids: Iterable[bytes]) -> range:
        """Their numbers."""
        begin = len(self.made.ends) - 1
        for x in ids:
            self.made.append(x)
        self.characters += sum(map(len, names))
        return range(begin, begin + len(names))

    def merge(self, words: list[str]) -> Iterable[bytes]:
        return self.model.merges.many([(x if x != "\r" else "\n").encode() for x in words], self.dtype)

    def kept_words(self, words: pa.Array) -> np.ndarray:
        """Numbers of words in the store."""
        coded = words.dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        got = list(map(self.words.get, names))
        if None in got:
            new = [x for x, k in zip(names, got, strict=True) if k is None]
            fresh = self.keep(new, self.merge(new))
            self.words |= zip(new, fresh, strict=True)
            following = iter(fresh)
            got = [next(following) if k is None else k for k in got]
        return np.array(got, np.int64)[coded.indices.to_numpy()]

    def numbers(self, names: list[str], first: bool) -> np.ndarray:
        """Numbers of distinct pieces in this run."""
        column, known, space = pa.array(names, pa.large_string()), self.known[first], "" if first else " "
        # a line feed begins a piece or is in none
        core = column if first else pc.utf8_ltrim(column, "\n")
        word = pc.utf8_rtrim(core, bpe.MARKS)
        plain = pc.match_substring_regex(word, SIMPLE)
        ok = plain.to_numpy(zero_copy_only=False)
        at, rest = np.flatnonzero(ok), np.flatnonzero(~ok)
        # a line feed, a word and marks after it, or a piece that is kept whole
        parts = np.zeros((len(names), 3), np.int64)
        if len(at):
            sizes = [pc.binary_length(x).to_numpy() for x in (column, core, word)]
            line, marks = (sizes[0] > sizes[1])[at], np.flatnonzero(ok & (sizes[1] > sizes[2]))
            parts[at[line], 0] = self.kept_words(pa.array(["\r"], pa.large_string()))[0] if line.any() else 0
            before, nothing = (pa.scalar(x, pa.large_string()) for x in (space, ""))
            parts[at, 1] = self.kept_words(pc.binary_join_element_wise(pc.if_else(pa.array(line), nothing, before), word.filter(plain), nothing))
            parts[marks, 2] = self.kept_words(pa.array([names[k][-n:] for k, n in zip(marks.tolist(), (sizes[1] - sizes[2])[marks].tolist(), strict=True)], pa.large_string()))
        if len(rest):
            whole = [names[k] for k in rest.tolist()]
            if new := list({x: None for x in whole if x not in known}):
                # a line feed was given a space before it, to be cut there
                known |= zip(new, self.keep(new, self.whole([(space + x).replace(" \n", "\n") for x in new])), strict=True)
            parts[rest, 1] = [known[x] for x in whole]
        self.made.arrays or self.made.freeze(self.dtype)
        begin, ends = len(self.open), np.cumsum(self.made.lengths(parts).sum(1)) * self.dtype.itemsize
        self.ids.ends.frombytes((ends + len(self.ids.flat)).astype(np.int64).tobytes())
        self.ids.flat += self.made.gather(parts.ravel()).tobytes()
        self.ids.arrays = None
        is_open = np.zeros(len(names), np.uint8)
        is_open[rest] = [not x or x[-1].isspace() for x in map(names.__getitem__, rest.tolist())]
        self.open += is_open.tobytes()
        return np.arange(begin, begin + len(names))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(self.made.ends) > (self.kept or bpe.KEPT_PIECES) or self.characters > bpe.KEPT_CHARACTERS:
            self.forget()
        self.ids, self.open = bpe.Joined(), bytearray()
        return super().encode(texts)

    def whole(self, texts: list[str]) -> Iterator[bytes]:
        cuts, known = [self.cut(x) for x in texts], self.matches
        new = list({x: None for cut in cuts for x in cut or () if isinstance(x, str) and x not in known})
        known |= zip(new, self.model.merges.many([x.encode() for x in new], self.dtype), strict=True)
        for text, cut in zip(texts, cuts, strict=True):
            if cut is None:
                encoder = Encoder(self.model)
                ids = array("I", encoder.feed(text))
                ids.extend(encoder.finish())
                yield np.array(ids, self.dtype).tobytes()
            else:
                yield b"".join([known[x] if isinstance(x, str) else np.array([x], self.dtype).tobytes() for x in cut])

    def cut(self, text: str) -> list[str | int] | None:
        """The matches of a short text, with the numbers of added tokens; None for a long one."""
        if len(text) > AT_ONCE:
            return None
        if self.model.special is None or not self.model.special.search(text):
            return self.model.cut(text)
        out, at = [], 0
        for m in self.model.special.finditer(text):
            out += [*self.model.cut(text[at : m.start()]), self.model.added[m.group()]]
            at = m.end()
        return out + self.model.cut(text[at:])


def model_of(path: str, specials: bool) -> Model:
    return bpe.once(("stream", path, specials), lambda: Model(path, specials))


def encode_bytes(text: Column, path: str, specials: bool = True) -> Column:
    """binary: the ids of a text as little-endian unsigned 32-bit integers. path: a tokenizer file that every machine has at that place."""

    def run(batch: pa.Array) -> pa.Array:
        made = bpe.once(("streamed", path, specials), lambda: Streamed(model_of(path, specials)))
        flat, ends = [], [np.zeros(1, np.int64)]
        for part in bpe.runs(batch):
            ids, to = made.encode(part)
            flat.append(ids)
            ends.append(to[1:] * 4 + ends[-1][-1])
        to = pa.array(np.concatenate(ends), pa.int64())
        return pa.Array.from_buffers(pa.large_binary(), len(batch), [None, to.buffers()[1], pa.py_buffer(np.concatenate(flat) if flat else b"")]).cast(pa.binary())

    return F.arrow_udf(run, T.BinaryType())(text)


def encode(text: Column, path: str, specials: bool = True) -> Column:
    """array<int>: the ids of a text."""
    return F.arrow_udf(lambda batch: pa.array([np.frombuffer(x, "<i4") for x in batch.to_pylist()], pa.list_(pa.int32())), T.ArrayType(T.IntegerType(), False))(encode_bytes(text, path, specials))


def decode(ids: Column, path: str) -> Column:
    """The text of ids as `encode_bytes` gives them; null for null. An id outside the vocabulary is an error."""

    def table() -> bpe.Joined:
        known = model_of(path, True).known
        made = bpe.Joined([known.get(i, b"") for i in range(max(known, default=-1) + 1)])
        made.freeze("u1")
        return made

    def text_of(data: pa.Buffer) -> str:
        state = codecs.getincrementaldecoder("utf-8")("replace")
        return "".join([state.decode(data[a : a + AT_ONCE]) for a in range(0, len(data), AT_ONCE)]) + state.decode(b"", True)

    def run(batch: pa.Array) -> pa.Array:
        known, out = bpe.once(("stream bytes", path), table), []
        for part in bpe.runs(batch):
            part = part.cast(pa.large_binary())
            ends = np.frombuffer(part.buffers()[1], "<i8")[part.offset : part.offset + len(part) + 1] // 4
            values = np.frombuffer(part.buffers()[2] or b"", "<u4")[ends[0] : ends[-1]].astype(np.int64)
            total = np.r_[0, np.cumsum(known.lengths(values))]
            to, flat = pa.array(total[ends - ends[0]], pa.int64()), known.gather(values)
            made = pa.Array.from_buffers(pa.large_binary(), len(part), [part.is_valid().buffers()[1] if part.null_count else None, to.buffers()[1], pa.py_buffer(flat)])
            try:
                out.append(made.cast(pa.string()))
            except pa.ArrowInvalid:  # ids that aren't a whole text's
                out.append(pa.array([None if x is None else text_of(x) for x in made.to_pylist()], pa.string()))
        return pa.concat_arrays(out) if out else pa.array([], pa.string())

    return F.arrow_udf(run, T.StringType())(ids)
