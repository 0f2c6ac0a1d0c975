"""Glossaries and term memories against texts: one automaton over all terms, in one pass over each text.

Terms that are one word are looked up among a text's distinct words. The others' literals go into an Aho-Corasick automaton over characters without case, and each
place where one ends is decided as the entry says: exactly or in any case, with no word character next to it, and with the entry's context near it. A
task builds both once; entries are few (`most`), so they travel with the task, and a row of the result is a text with one entry.

Null and empty texts match nothing. Equal entries count once; of texts that repeat each has its rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.package import ship

# Entries of a glossary, records of a memory, what is shown of them, and characters around a term that its context is looked for in.
MOST_ENTRIES, MOST_TERMS, MOST_HINTS, SHOWN_TERMS, SHOWN_HINTS, CONTEXT = 200, 160, 80, 8, 2, 160
LEVELS, MODES = ("preserve", "canonical", "preferred"), ("exact", "case_insensitive", "regex")
EDGE = " ,.;:()[]{}，。；：（）【】"
KEY_LENGTH, VALUE_LENGTH, VALUE_CJK, KEY_WORDS, LINE = 80, 12, 8, 4, 8
STOP_KEYS = ("or", "and", "the", "from", "with", "for", "this", "that")
VALUE_STOPS = ("的", "已", "将", "被", "从", "在", "这", "其")
TERMS_HEAD, HINTS_HEAD = "当前块相关文档记忆：术语保持一致。", "当前块相关文档记忆：以下内容此前更适合保留技术排版。"
CJK, PUNCTUATION = "[一-鿿]", "[，。；：、,.!?！？]"


class Caseless(dict):
    """For str.translate: one character for all that differ by case, so that places stay."""

    def __missing__(self, point: int) -> int:
        c = chr(point)
        upper = c.upper()
        low = (upper if len(upper) == 1 else c).lower()
        self[point] = ord(low) if len(low) == 1 else ord(low[0]) if c == "İ" else point
        return self[point]


CASELESS = Caseless()


def bare(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(CASELESS)


class Automaton:
    """Where any of some literals ends in a text, in whatever case."""

    def __init__(self, literals: list[str]):
        import ahocorasick

        self.made = ahocorasick.Automaton()
        for i, x in enumerate(map(bare, literals)):
            self.made.add_word(x, (*self.made.get(x, (len(x),)), i))
        if literals:
            self.made.make_automaton()

    def places(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(literal's number, first character, the one after the last), by the last."""
        if len(self.made):
            for last, (n, *numbers) in self.made.iter(bare(text)):
                for i in numbers:
                    yield i, last + 1 - n, last + 1


#: Letters that equal one of A-Z where case is ignored.
NO_CASE = "İıſ\u212a"


def is_word(c: str, any_case: bool, underscore: bool) -> bool:
    return c.isalnum() if c.isascii() and c != "_" else underscore if c == "_" else any_case and c in NO_CASE


def bounded(text: str, a: int, b: int, any_case: bool, underscore: bool = True) -> bool:
    """No letter, digit or (if wanted) underscore of ASCII touches text[a:b]."""
    return not (a and is_word(text[a - 1], any_case, underscore) or b < len(text) and is_word(text[b], any_case, underscore))


#: Runs of word characters, with and without the underscore. A term that is such a run is in a text, bounded, if it is one of the text's runs.
RUN, PLAIN_RUN = re.compile("[A-Za-z0-9_]+"), re.compile("[A-Za-z0-9]+")


class Glossary:
    """Entries (source, target, level, mode, context) in the order in which they apply: longest first."""

    def __init__(self, entries: list[tuple[str, str, str, str, str | None]]):
        self.entries = entries
        self.words: dict[str, dict[str, list[int]]] = {"exact": {}, "case_insensitive": {}}
        self.patterns, self.others = {}, []
        for i, (source, _, _, mode, context) in enumerate(entries):
            if mode == "regex":
                try:
                    self.patterns[i] = re.compile(source)
                except re.error:  # matches nothing
                    continue
            elif RUN.fullmatch(source):
                self.words[mode].setdefault(source if mode == "exact" else source.lower(), []).append(i)
                if context:
                    self.patterns[i] = re.compile(f"(?<![A-Za-z0-9_]){source}(?![A-Za-z0-9_])", re.IGNORECASE if mode != "exact" else 0)
            else:
                self.others.append(i)
        self.automaton = Automaton([entries[i][0] for i in self.others])
        # in any case: the literal as the pattern engine compares it
        self.literal = {i: re.compile(re.escape(entries[i][0]), re.IGNORECASE) for i in self.others if entries[i][3] == "case_insensitive"}

    def near(self, text: str, context: str | None, a: int, b: int) -> bool:
        return not context or context.casefold() in text[max(0, a - CONTEXT) : b + CONTEXT].casefold()

    def found(self, text: str | None) -> list[int]:
        """Numbers of the entries that match, in order."""
        if not text:
            return []
        hit, end = set(), {}
        for mode, words in self.words.items():
            if words:
                for word in words.keys() & set(RUN.findall(text if mode == "exact" else bare(text))):
                    hit.update(words[word])
        for i, pattern in self.patterns.items():
            mode, context = self.entries[i][3:]
            if mode != "regex" and i not in hit:
                continue
            near = any(self.near(text, context, m.start(), m.end()) for m in pattern.finditer(text))
            (hit.add if near else hit.discard)(i)
        for k, a, b in self.automaton.places(text):
            i = self.others[k]
            source, _, _, mode, context = self.entries[i]
            if i in hit or a < end.get(i, 0):
                continue
            same = text[a:b] == source if mode == "exact" else self.literal[i].match(text, a)
            if same and bounded(text, a, b, mode != "exact"):
                end[i] = b  # matches of one entry don't overlap
                if self.near(text, context, a, b):
                    hit.add(i)
        return sorted(hit)


@lru_cache(maxsize=8)
def _glossary(entries: tuple) -> Glossary:
    return Glossary(list(entries))


def over_texts(text: Column, find: Callable[[str | None], object], kind: T.DataType, arrow: pa.DataType) -> Column:
    """find of each text, computed once: a function said to be deterministic would be run again for the filter that exploding its result implies."""
    return F.arrow_udf(lambda batch: pa.array([find(x.as_py()) for x in batch], arrow), kind).asNondeterministic()(text)


def few(df: DataFrame, most: int, what: str) -> list:
    """The rows of a table that has a most."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{what} have at most {most} rows")
    return rows


def entries_of(glossary: DataFrame) -> list[tuple[str, str, str, str, str | None]]:
    """The entries of source, target, level, match_mode, context, trimmed, in their order; those without source or target aren't entries."""
    made = []
    for r in few(glossary.select("source", "target", "level", "match_mode", "context"), MOST_ENTRIES, "glossaries"):
        source, target, context = ((x or "").strip() for x in (r.source, r.target, r.context))
        level, mode = (r.level or "").strip().lower(), (r.match_mode or "").strip().lower()
        if source and target:
            made.append((source, target, level if level in LEVELS else "preferred", mode if mode in MODES else "exact", context or None))
    made.sort(key=lambda e: (-len(e[0]), e[0].casefold(), *e[:4], e[4] or ""))
    seen: dict[tuple, tuple] = {}
    for e in made:  # a later equal entry matches no text that the first doesn't, unless modes differ
        seen.setdefault((e[0].casefold(), e[1].casefold(), e[2], (e[4] or "").casefold(), e[0], e[3]), e)
    return list(seen.values())


def matched_entries(texts: DataFrame, glossary: DataFrame, text_col: str, levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """The texts with each entry that matches them: source, target, level, context and place (from 1) in the order longest first.

    Of entries whose source, target, level and context are equal but for case a text has the first that matches.
    """
    spark = texts.sparkSession
    ship(spark)
    entries = tuple(e for e in entries_of(glossary) if e[2] in levels)
    key = [(e[0].casefold(), e[1].casefold(), e[2], (e[4] or "").casefold()) for e in entries]

    def find(text: str | None) -> list[int]:
        once: dict[tuple, int] = {}
        for i in _glossary(entries).found(text):
            once.setdefault(key[i], i)
        return list(once.values())

    named = spark.createDataFrame([(i, e[0], e[1], e[2], e[4]) for i, e in enumerate(entries)], "__entry int, source string, target string, level string, context string")
    hits = texts.withColumn("__hits", over_texts(F.col(text_col), find, T.ArrayType(T.IntegerType()), pa.list_(pa.int32())))
    return hits.select(*texts.columns, F.posexplode("__hits").alias("__at", "__entry")).join(F.broadcast(named), "__entry").select(*texts.columns, "source", "target", "level", "context", (F.col("__at") + 1).alias("place"))


def present_terms(text: Column, terms: list[str]) -> Column:
    """array<string>: the terms that are in a text with no word character next to them; compared as they are."""
    entries = tuple((t, t, "preferred", "exact", None) for t in terms)
    return over_texts(text, lambda x: [entries[i][0] for i in _glossary(entries).found(x)], T.ArrayType(T.StringType()), pa.list_(pa.string()))


def squeezed(text: str | None) -> str:
    return re.sub(r"\s+", " ", text or "").strip()


def cleaned(text: str | None) -> str:
    return squeezed(text).strip(EDGE)[:KEY_LENGTH]


def is_shown(key: str, value: str) -> bool:
    """Whether a memory's term is fit to be shown: a short key with letters, and the key itself or a short CJK noun as value."""
    if len(key) < 2 or key.lower() in STOP_KEYS or not any(c.isalpha() for c in key) or len(key.split()) > KEY_WORDS or not value:
        return False
    if key.lower() == value.lower():
        return True
    n = len(re.findall(CJK, value))
    return 0 < n <= VALUE_CJK and len(value) <= VALUE_LENGTH and not re.search(PUNCTUATION, value) and not any(w in value for w in VALUE_STOPS)


class Memory:
    """Terms (key, value, hits) and hints (key, hits) of a memory, for looking them up in sources."""

    def __init__(self, terms: list[tuple[str, str, int]], hints: list[tuple[str, int]]):
        of = [(raw or "", cleaned(raw), cleaned(value), hits or 0) for raw, value, hits in terms]
        self.terms = sorted((x for x in of if x[3] >= 1 and is_shown(x[1], x[2])), key=lambda x: (-x[3], -len(x[1]), x[0]))
        self.hints = sorted(((k or "", h or 0) for k, h in hints), key=lambda x: (-x[1], x[0]))
        self.plain = [i for i, x in enumerate(self.terms) if re.search("[A-Za-z0-9]", x[1])]
        self.odd = [i for i, x in enumerate(self.terms) if not re.search("[A-Za-z0-9]", x[1])]
        self.words: dict[str, list[int]] = {}
        for i in self.plain:
            if PLAIN_RUN.fullmatch(self.terms[i][1]):
                self.words.setdefault(self.terms[i][1].lower(), []).append(i)
        self.plain = [i for i in self.plain if not PLAIN_RUN.fullmatch(self.terms[i][1])]
        self.automaton = Automaton([self.terms[i][1] for i in self.plain])
        self.literal = [re.compile(re.escape(self.terms[i][1]), re.IGNORECASE) for i in self.plain]
        self.hint = [squeezed(k).lower() for k, _ in self.hints]
        self.hint_automaton = Automaton([h for h in self.hint if h])
        self.numbers = [i for i, h in enumerate(self.hint) if h]
        self.hint_lines: dict[str, list[int]] = {}
        for i, (k, _) in enumerate(self.hints):
            for line in k.splitlines():
                if self.hint[i] and len(line.strip()) >= LINE:
                    self.hint_lines.setdefault(line.strip().lower(), []).append(i)

    def recall(self, text: str | None) -> tuple[list[int], list[int]]:
        """Numbers of the terms and of the hints to show for a source, in order."""
        source = squeezed(text)
        if not source:
            return [], []
        low = source.lower()
        got = {i for i in self.odd if self.terms[i][1].lower() in low}
        for word in self.words.keys() & set(PLAIN_RUN.findall(bare(source))) if self.words else ():
            got.update(self.words[word])
        for k, a, b in self.automaton.places(source):
            if self.plain[k] not in got and bounded(source, a, b, True, False) and self.literal[k].match(source, a):
                got.add(self.plain[k])
        hints = {self.numbers[k] for k, _, _ in self.hint_automaton.places(low) if self.hint[self.numbers[k]] in low}
        hints |= {i for i, h in enumerate(self.hint) if h and len(h) >= len(low) and low in h}
        hints |= {i for line in text.splitlines() if len(line.strip()) >= LINE for i in self.hint_lines.get(line.strip().lower(), ())}
        return sorted(got)[:SHOWN_TERMS], sorted(hints)[:SHOWN_HINTS]

    def summary(self, text: str | None) -> str:
        terms, hints = self.recall(text)
        lines = [TERMS_HEAD] * bool(terms) + [f"- {self.terms[i][1]} => {self.terms[i][2]}" for i in terms]
        return "\n".join(lines + [HINTS_HEAD] * bool(hints) + [f"- {self.hints[i][0]}" for i in hints]).strip()


@lru_cache(maxsize=8)
def _memory(terms: tuple, hints: tuple) -> Memory:
    return Memory(list(terms), list(hints))


def recalled(texts: DataFrame, terms: DataFrame, hints: DataFrame, text_col: str) -> DataFrame:
    """The texts with what a memory has for them: summary, term_keys (at most SHOWN_TERMS, most hits first, then longest) and hint_keys (SHOWN_HINTS).

    terms: key, value, hits; hints: key, hits. A term is in a text in any case and with no letter or digit of ASCII next to it; one without such characters
    anywhere. A hint matches if it contains the text or the text it, or if they share a line of LINE characters or more, spaces and case apart.
    """
    ship(texts.sparkSession)
    t = tuple((r.key, r.value, r.hits) for r in few(terms.select("key", "value", "hits"), MOST_TERMS, "memories' terms"))
    h = tuple((r.key, r.hits) for r in few(hints.select("key", "hits"), MOST_HINTS, "memories' hints"))

    def find(text: str | None) -> dict:
        m = _memory(t, h)
        a, b = m.recall(text)
        return {"summary": m.summary(text), "term_keys": [m.terms[i][0] for i in a], "hint_keys": [m.hints[i][0] for i in b]}

    words = T.ArrayType(T.StringType())
    kind = T.StructType([T.StructField("summary", T.StringType()), T.StructField("term_keys", words), T.StructField("hint_keys", words)])
    arrow = pa.struct([("summary", pa.string()), ("term_keys", pa.list_(pa.string())), ("hint_keys", pa.list_(pa.string()))])
    return texts.withColumn("__memory", over_texts(F.col(text_col), find, kind, arrow)).select(*texts.columns, "__memory.*")
