"""Byte-level BPE with the tokenizers library, over Arrow batches.

A text is cut at places where no match of the split pattern can cross: before white space that follows anything else. What
lies between two cuts is encoded once for each Python worker and then looked up, so the library sees each distinct
piece instead of each occurrence. Arrow cuts a batch at its spaces and line feeds and finds its distinct pieces; ids are gathered
by numpy. (A piece of letters and marks is handed to the library's model as its matches, in characters
that stand for bytes; any other, whole.) Pieces follow each other without gaps, hence the ids of a text are those
that the library gives for the whole text.

Null texts count as empty; empty texts give no ids. Texts may be of any length.
"""

from __future__ import annotations

import base64
import codecs
import os
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm import common

#: Letters and marks. A line feed, letters (with a space before them) and marks after them are separate matches of the split pattern, whatever stands around them.
LETTERS, MARKS = re.compile(r"[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+"), ".,;:!?*$%&#|"
#: Distinct pieces, and characters of these, that a Python worker keeps.
KEPT_PIECES, KEPT_CHARACTERS = 600_000, 40_000_000
#: Bytes of text that are cut at once, and ids or pieces that are gathered at once.
AT_ONCE, GATHERED = 4_000_000, 500_000
#: KEPT_PIECES and AT_ONCE where a worker shares its executor with much else: a third of the memory for a tenth more time.
FEW_PIECES, LITTLE = 250_000, 1_500_000


def byte_table() -> list[str]:
    """The character that stands for each byte: itself if printable in Latin-1, else one from U+0100 on, in order."""
    shown = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)}
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


def token_bytes(tokenizer) -> list[bytes]:
    """The bytes of each id of a byte-level tokenizer; unknown ids and added tokens as their text."""
    back = {c: b for b, c in enumerate(byte_table())}
    vocab = tokenizer.get_vocab(with_added_tokens=True)
    out = [b""] * (max(vocab.values(), default=-1) + 1)
    for text, i in vocab.items():
        out[i] = bytes(back[c] for c in text) if all(c in back for c in text) else text.encode()
    return out


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a token in base64 and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def tokenizer_of_ranks(ranks: dict[bytes, int]):
    """A tokenizer of the library that merges as the ranks say.

    Merging by ranks joins two neighbours if the joined bytes have a rank, the lowest first. The library wants
    pairs, so each token gives one merge for every way to cut it into two tokens, in order of its rank.
    A piece that is a token as a whole is taken as it is, as merging by ranks does.
    """
    from tokenizers import Tokenizer, models, pre_tokenizers

    shown = byte_table()
    word = {token: "".join(shown[b] for b in token) for token in ranks}
    merges = [(word[t[:i]], word[t[i:]]) for t in sorted(ranks, key=ranks.get) for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
    made = Tokenizer(models.BPE(vocab={word[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
    made.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    return made


def load_tokenizer(path: str):
    """A tokenizer from the library's JSON or a rank file. Strings of special tokens in a text are ordinary text."""
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    made = tokenizer_of_ranks(read_ranks(path)) if path.endswith(".tiktoken") else Tokenizer.from_file(path)
    made.encode_special_tokens = True
    return made


class Joined:
    """Byte strings one after another, gathered by number."""

    def __init__(self, parts: Iterable[bytes] = ()):
        self.flat, self.ends = bytearray(), array("q", [0])
        for x in parts:
            self.append(x)
        self.arrays = None

    def append(self, x: bytes) -> None:
        self.flat += x
        self.ends.append(len(self.flat))
        self.arrays = None

    def freeze(self, dtype) -> None:
        ends = np.array(self.ends) // np.dtype(dtype).itemsize
        self.arrays = np.frombuffer(bytes(self.flat), dtype), ends[:-1], np.diff(ends)

    def lengths(self, numbers: np.ndarray) -> np.ndarray:
        return self.arrays[2][numbers]

    def gather(self, numbers: np.ndarray) -> np.ndarray:
        """The strings of the numbers, joined."""
        flat, start, size = self.arrays
        out, at = np.empty(int(size[numbers].sum()), flat.dtype), 0
        for a in range(0, len(numbers), GATHERED):
            some = numbers[a : a + GATHERED]
            n = size[some]
            ends = np.cumsum(n)
            total = int(ends[-1])
            out[at : at + total] = flat[np.repeat(start[some] - ends + n, n) + np.arange(total)]
            at += total
        return out


class Pieces:
    """Ids of texts as little-endian unsigned integers, through a bounded store of pieces."""

    def __init__(self, tokenizer, dtype: str = "<u4", kept: int | None = None):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.dtype, self.kept = tokenizer, np.dtype(dtype), kept
        #: For matches in characters that stand for bytes, with spaces between them.
        self.merger = Tokenizer(tokenizer.model)
        self.merger.pre_tokenizer = pre_tokenizers.Split(" ", "removed")
        shown = byte_table()
        self.shown = dict(enumerate(shown)) | {10: " ", 13: shown[10]}
        vocab = tokenizer.get_vocab(with_added_tokens=False)
        self.size = np.zeros(max(vocab.values(), default=0) + 1, np.int64)
        self.size[list(vocab.values())] = list(map(len, vocab))
        self.forget()

    def forget(self) -> None:
        """Numbers of pieces, by their text without the space before them; pieces that begin a text are apart."""
        self.known: tuple[dict[str, int], dict[str, int]] = ({}, {})
        self.words: dict[str, bytes] = {"": b""}
        self.ids, self.open, self.characters = Joined(), bytearray(), 0

    def merge(self, words: list[str]) -> None:
        """Learn the ids of matches of the split pattern: their bytes as characters, merged by the library. A line feed comes as a carriage return."""
        shown = [x if x.isascii() else x.encode().decode("latin-1") for x in words]
        made = self.merger.encode_batch_fast(["\n".join(shown).translate(self.shown)], add_special_tokens=False)[0].ids
        ids = np.array(made, self.dtype)
        # tokens cover the characters without gaps
        ends = np.searchsorted(np.cumsum(self.size[ids]), np.cumsum(list(map(len, shown))), "right") * self.dtype.itemsize
        flat = ids.tobytes()
        self.words |= zip(words, (flat[a:b] for a, b in pairwise([0, *ends.tolist()])), strict=True)

    def add(self, known: dict[str, int], name: str, ids: bytes) -> None:
        known[name] = len(self.open)
        self.characters += len(name)
        self.open.append(not name or name[-1].isspace())
        self.ids.append(ids)

    def numbers(self, names: list[str], first: bool) -> np.ndarray:
        got = list(map(self.known[first].get, names))
        if None in got:
            self.learn([x for x, k in zip(names, got, strict=True) if k is None], first)
            got = list(map(self.known[first].get, names))
        return np.array(got, np.int32)

    def learn(self, names: list[str], first: bool) -> None:
        """Number new pieces."""
        known, words, rest, parts, space = self.known[first], self.words, {}, {}, "" if first else " "
        for name in names:
            line = not first and name[:1] == "\n"
            core = name[line:]
            word = core.rstrip(MARKS)
            if word.isalpha() and (word.isascii() or LETTERS.fullmatch(word)):
                parts[name] = ("\r", word, core[len(word) :]) if line else ("", space + word, core[len(word) :])
            else:
                # a line feed was given a space before it, to be cut there
                rest[name] = (space + name).replace(" \n", "\n")
        new = list({x: None for part in parts.values() for x in part if x not in words})
        if new:
            self.merge(new)
        for name, (line, word, marks) in parts.items():
            self.add(known, name, words[line] + words[word] + words[marks])
        for name, ids in zip(rest, self.whole(list(rest.values())) if rest else (), strict=True):
            self.add(known, name, ids)

    def whole(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of texts that the library cuts itself."""
        return (array(self.dtype.char, made.ids).tobytes() for made in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False))

    def number(self, pieces: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all pieces, and where each text's end. Where one ends in white space, it and the next are one piece."""
        ends = pieces.offsets.to_numpy().astype(np.int64)
        coded = pieces.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode()
        ends -= ends[0]
        names, of = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        number = self.numbers(names, False)[of]
        is_open = np.frombuffer(self.open, np.uint8).astype(bool)[number]
        begins = np.r_[True, ~is_open[:-1]]
        begins[ends[:-1]] = True
        start = np.flatnonzero(begins)
        size = np.diff(np.r_[start, len(number)])
        number = number[start]
        texts = np.searchsorted(start, ends[:-1])
        first = np.zeros(len(start), bool)
        first[texts] = True
        odd = np.flatnonzero(first | (size > 1))
        joined = [" ".join([names[k] for k in of[a : a + n].tolist()]) for a, n in zip(start[odd].tolist(), size[odd].tolist(), strict=True)]
        for side in (False, True):
            at = np.flatnonzero(first[odd] == side)
            number[odd[at]] = self.numbers([joined[k] for k in at.tolist()], side)
        return number, np.r_[texts, len(start)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where each text's end."""
        if not len(texts):
            return np.empty(0, self.dtype), np.zeros(1, np.int64)
        if len(self.open) > (self.kept or KEPT_PIECES) or self.characters > KEPT_CHARACTERS:
            self.forget()
        texts = texts.fill_null("").cast(pa.large_string())
        number, ends = self.number(pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " "))
        self.ids.arrays or self.ids.freeze(self.dtype)
        total = np.r_[0, np.cumsum(self.ids.lengths(number))]
        return self.ids.gather(number), total[ends]


_made: dict[tuple, object] = {}


def once(key: tuple, make: Callable):
    """What make() gives, kept for the life of a Python worker."""
    if key not in _made:
        _made[key] = make()
    return _made[key]


def pieces(path: str, dtype: str = "<u4", kept: int | None = None) -> Pieces:
    return once(("pieces", path, dtype, kept), lambda: Pieces(once(("tokenizer", path), lambda: load_tokenizer(path)), dtype, kept))


def runs(texts: pa.Array, at_once: int | None = None) -> Iterator[pa.Array]:
    """The texts in runs of AT_ONCE bytes or little more; a longer text is a run of its own."""
    size = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + (at_once or AT_ONCE), "right")))
        yield texts.slice(a, b - a)
        a = b


def encode(text: Column, path: str) -> Column:
    """array<int>: the ids of a text. path: a tokenizer file that every machine has at that place."""

    def run(batch: pa.Array) -> pa.Array:
        ids, ends = [np.empty(0, "<u4")], [np.zeros(1, np.int64)]
        for part in runs(batch):
            made, to = pieces(path).encode(part)
            ends.append(to[1:] + ends[-1][-1])
            ids.append(made)
        return pa.ListArray.from_arrays(pa.array(np.concatenate(ends), pa.int32()), pa.array(np.concatenate(ids).view("<i4")))

    return F.arrow_udf(run, T.ArrayType(T.IntegerType(), False))(text)


def encode_checked(text: Column, path: str) -> Column:
    """struct<ids, same_text>: the ids of a text, and whether their bytes are the text's.

    Ids are made once (decode_bytes(encode(text)) beside encode(text) makes them twice) and decoded run by run, and no decoded bytes leave the worker.
    Of a task's pieces nothing is kept: an executor can have more workers than cores, of which each would hold a store of its own while it is idle.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            for batch in batches:
                for part in runs(batch, LITTLE):
                    ids, ends = pieces(path, kept=FEW_PIECES).encode(part)
                    same = pc.equal(_bytes_of(ids, ends, path), part.fill_null("").cast(pa.large_string()).cast(pa.large_binary()))
                    yield pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.view("<i4"))), same], ["ids", "same_text"])
        finally:
            pieces(path, kept=FEW_PIECES).forget()
            common.give_back()

    return F.arrow_udf(run, T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("same_text", T.BooleanType())]))(text)


def offsets(ids: Column, path: str) -> Column:
    """array<struct<start, end>>: for each id the characters of the text that its bytes belong to.

    A character whose bytes are shared by several tokens counts for each of them.
    """

    def run(batch: pa.Array) -> pa.Array:
        known = once(("bytes", path), lambda: token_bytes(once(("tokenizer", path), lambda: load_tokenizer(path))))
        rows = []
        for row in batch.to_pylist():
            made, at = [], 0  # at: characters that are begun
            for b in (known[i] for i in row or []):
                first = at if b[:1] and b[0] & 0xC0 != 0x80 else at - 1
                at += sum(x & 0xC0 != 0x80 for x in b)
                made.append({"start": max(first, 0), "end": at})
            rows.append(made)
        return pa.array(rows, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))

    kind = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    return F.arrow_udf(run, kind)(ids)


def _bytes_of(ids: np.ndarray, ends: np.ndarray, path: str, valid: pa.Array | None = None) -> pa.Array:
    """large_binary: the bytes of the ids, in rows that end at ends (the first of these is 0)."""

    def known() -> Joined:
        made = Joined(token_bytes(once(("tokenizer", path), lambda: load_tokenizer(path))))
        made.freeze("u1")
        return made

    table = once(("joined", path), known)
    total = np.r_[0, np.cumsum(table.lengths(ids))]
    to = pa.array(total[ends].astype(np.int64), pa.int64())
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [valid.buffers()[1] if valid is not None else None, to.buffers()[1], pa.py_buffer(table.gather(ids))])


def decode_bytes(ids: Column, path: str) -> Column:
    """binary: the bytes of the ids; null for null. An id outside the vocabulary is an error."""

    def run(batch: pa.Array) -> pa.Array:
        ends = batch.offsets.to_numpy()
        values = batch.values.slice(int(ends[0]), int(ends[-1] - ends[0])).to_numpy(zero_copy_only=False)
        return _bytes_of(values, ends - ends[0], path, pc.invert(batch.is_null()) if batch.null_count else None).cast(pa.binary())

    return F.arrow_udf(run, T.BinaryType())(ids)


def decode(ids: Column, path: str) -> Column:
    """The text of the ids. Bytes are joined before they are read as UTF-8, so characters may be split over tokens."""
    return F.try_validate_utf8(decode_bytes(ids, path).cast("string"))


def decode_stream(ids: Iterable[int], known: list[bytes]) -> Iterator[str]:
    """Text as far as whole characters have come; an unfinished one waits for the next id."""
    reader = codecs.getincrementaldecoder("utf-8")("replace")
    for i in ids:
        if text := reader.decode(known[i]):
            yield text
    if text := reader.decode(b"", True):
        yield text


def local_file(path: str) -> str:
    """path, or what SparkContext.addFile has brought under its name."""
    return path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))
