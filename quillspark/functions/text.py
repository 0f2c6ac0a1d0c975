"""Predicates and measures over text, as columns.

A null text counts as empty. Words, letters and word borders are spelled out as character classes, so that the same
pattern means the same in Spark and in the SQL that the tests run.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and word lists that decide results.
WORD = r"[A-Za-z]+(?:[-'][A-Za-z]+)?"
EMAIL = r"^[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_.-]+\.[A-Za-z]{2,}$"
URL = r"(?i)^(?:(?:https?://|ftp://|www\.)[^ \t\r\n]+|(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?:/[A-Za-z0-9._~:/?#\[\]@!$&()*+,;=%-]*)?)$"
AROUND = "()[]<>\"'“”‘’,;"
COPYRIGHT = r"(?i)(^|[^\p{L}\p{N}_])(?:copyright|all rights reserved|trademarks?|registered|unregistered|intellectual property rights?)([^\p{L}\p{N}_]|$)"
COPYRIGHT_SIGNALS = (
    "all rights reserved", "copyright", "trademark", "trademarks", "registered trademark", "registered and unregistered",
    "intellectual property rights", "key symbol", "periodicals",
)
DISCLAIMERS = (
    "redistribution of this document", "accepts no liability", "written permission", "this material is distributed",
    "advised to seek independent professional advice",
)
PROSE_CUES = (
    "a|an|the|this|that|these|those|is|are|was|were|be|been|being|has|have|had|do|does|did|can|could|may|might|must|should|would|will|our|their|its|during|through|within|than|"
    "therefore|however|because|while|where|which|whose|method|function|equation|theory|energy|calculation|model|procedure|results|using|used|shows|demonstrates"
)
OPERATORS = r"[(){}\[\]=*<>+/,;:]"
YEAR = r"(?i)(^|[^\p{L}\p{N}_])(?:18|19|20)[0-9]{2}[a-z]?([^\p{L}\p{N}_]|$)"
DOI = r"(?i)(^|[^\p{L}\p{N}_])doi([^\p{L}\p{N}_]|$)|10\.[0-9]{4,9}/|https?://"
JOURNAL = r"(?i)(^|[^\p{L}\p{N}_])(?:j\.|journal|chem|phys|soc|rev\.?|lett\.?|commun\.?|proc\.?|science|nature|acs|springer|elsevier|wiley|vol\.?|volume|pages?|pp\.?|issue|no\.?)([^\p{L}\p{N}_]|$)"
PAGES = r"(^|[^\p{L}\p{N}_])[0-9]{1,4} *[-–] *[0-9]{1,5}([^\p{L}\p{N}_]|$)"
INDEXED = r"^\(?\[?[0-9]{1,3}\]?\)?[.)]? "
AUTHOR = r"^(?:\(?\[?[0-9]{1,3}\]?\)?[.)]? +)?(?:[A-Z][A-Za-z'`.-]+(?: +[A-Z][A-Za-z'`.-]+){0,2} *, *(?:[A-Z]\. *)+)"
PLACEHOLDER, PLACEHOLDER_SIGNS = r"<[futnvc][0-9]+-[0-9a-z]{3}/>|\[\[FORMULA_[0-9]+\]\]|@@[FP][0-9]+@@", ("<", "[[", "@@")
HEX_BYTE = r"^[0-9A-Fa-f]{2}$"
HEX_TOKEN = r"(?<![^ ])[0-9A-Fa-f]{2}(?![^ ])"
ODD = r"[^\p{L}\p{N} \t\r\n.,;:!?()\[\]{}'\"_/+*&%$#=@-]"
CJK = r"[\x{4e00}-\x{9fff}]"
#: What makes a text's white space more than single spaces between words.
ODD_SPACES = ("  ", "\t", "\r", "\n", "\f", "\x0b")
# The longest note of rights, and the fewest bytes of a dump.
NOTE_LENGTH, HEX_LEAST = 220, 32
TERMINAL, SOFT = r"[.!?:;]$", r",$"
CONTINUES = ("and", "or", "but", "with", "without", "whereas", "while", "which", "that", "than", "then", "thus", "therefore", "however", "nevertheless", "moreover", "furthermore", "second")
ENDS_OPEN = ("the", "a", "an", "of", "to", "for", "with", "and", "or", "but", "that", "these", "those", "this", "two", "three", "four", "five", "several", "many", "more", "less")
SUSPICIOUS = ("is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "can", "could", "may", "might", "should", "would", "must", "will", "shall")
HEADING = r"^(?:\(?[0-9]+(?:\.[0-9]+)*\)?[.)]? +|[A-Z][A-Z -]{3,}|[•*-] +)"


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often body uses it."""
    return F.transform(F.array(value), body)[0]


def empty_for_null(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def normalized(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(empty_for_null(text), r"[ \t\r\n\f\x0B]+", " "))


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def english_words(text: Column) -> Column:
    return count(empty_for_null(text), WORD)


def natural_words(text: Column) -> Column:
    """English words of three characters or more."""
    return F.size(F.filter(F.regexp_extract_all(empty_for_null(text), F.lit(f"({WORD})"), 1), lambda w: F.length(w) >= 3)).cast("long")


def cjk_chars(text: Column) -> Column:
    return count(empty_for_null(text), CJK)


def has_any(text: Column, parts: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in parts])


def stripped(text: Column) -> Column:
    return F.btrim(F.btrim(empty_for_null(text), F.lit(" \t\r\n\f\x0b")), F.lit(AROUND))


def is_url(text: Column) -> Column:
    """Cheap tests first: a URL has no space and has a dot or a colon."""
    t = stripped(text)
    return ~F.contains(t, F.lit(" ")) & t.rlike("[.:]") & t.rlike(URL)


def is_email(text: Column) -> Column:
    return F.contains(empty_for_null(text), F.lit("@")) & stripped(text).rlike(EMAIL)


def note_of_rights(t: Column) -> Column:
    """Of a normalized text: a short note of rights, at most NOTE_LENGTH characters and 32 words, and no disclaimer. Length and signals are tested first."""
    low = F.lower(t)
    return F.when((F.length(t) <= NOTE_LENGTH) & has_any(low, COPYRIGHT_SIGNALS), t.rlike(COPYRIGHT) & (count(t, WORD) <= 32) & ~has_any(low, DISCLAIMERS)).otherwise(F.lit(False))


def is_copyright_tail(text: Column) -> Column:
    return let(normalized(text), note_of_rights)


def is_hard_nontranslatable(text: Column) -> Column:
    return is_url(text) | is_email(text) | is_copyright_tail(text)


def is_code_literal(text: Column) -> Column:
    """Code rather than prose: of 2 to 64 tokens, half (three at least) look like code, and prose is scarce."""
    token = "|".join([OPERATORS, "_", r"(?i:(?:^|[^\p{L}\p{N}_])[0-9]+(?:\.[0-9]+)?D[+-]?[0-9]+(?:[^\p{L}\p{N}_]|$))", r"^[A-Z][A-Z0-9_.-]{3,}$", r"[A-Za-z].*[0-9]", r"[0-9].*[A-Za-z]"])

    def shape(t: Column, n: Column, codeish: Column) -> Column:
        operators, cues = count(t, OPERATORS), t.rlike(rf"(?i)(^|[^\p{{L}}\p{{N}}_])(?:{PROSE_CUES})([^\p{{L}}\p{{N}}_]|$)")
        capitals = count(t, r"\p{Lu}") >= 0.55 * F.greatest(F.lit(1), count(t, r"\p{L}"))
        loop = (codeish >= 2) & t.rlike(r"(?i)(^|[^\p{L}\p{N}_])DO[0-9]+[A-Z] *=")
        return loop | ((codeish >= F.greatest(F.lit(3), F.floor(n / 2))) & ((natural_words(t) <= 4) | (capitals & ~cues) | (operators >= F.greatest(F.lit(6), F.floor(F.length(t) / 18)))))

    def judged(t: Column) -> Column:
        n = F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1
        fits = (F.length(t) >= 24) & (n <= 64) & (n >= 2) & ~t.rlike(CJK)
        return F.when(fits, let(F.size(F.filter(F.split(t, " "), lambda w: w.rlike(token))), lambda c: shape(t, n, c))).otherwise(F.lit(False))

    return let(normalized(text), judged)


def is_reference_entry(text: Column) -> Column:
    """A bibliography's entry, from years, DOIs, journals, page ranges, indexes and authors."""

    def judged(t: Column) -> Column:
        commas = count(t, "[,;]")
        year, doi, journal, pages, indexed, author = (t.rlike(p) for p in (YEAR, DOI, JOURNAL, PAGES, INDEXED, AUTHOR))
        # Each of the three ways needs a digit or an author; most text has neither.
        way = (doi & (year | (commas >= 1))) | ((indexed | author) & (year | doi | journal | pages | (commas >= 2))) | (year & (journal | pages) & (commas >= 1))
        return F.when(t.rlike("[0-9]|(?i:doi|https?://)") | author, way).otherwise(F.lit(False))

    return let(normalized(text), judged)


def hex_dump(t: Column) -> Column:
    """Of a normalized text: 24 tokens or more, of which many (HEX_LEAST at least) are two hexadecimal digits."""
    n, b = F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1, count(t, HEX_TOKEN)
    return F.when(n >= HEX_LEAST, ((b >= HEX_LEAST) & (b >= 0.55 * n)) | ((b >= 128) & (b >= 0.35 * n))).otherwise(F.lit(False))


def is_hex_dump(text: Column) -> Column:
    return let(normalized(text), hex_dump)


def without_placeholders(text: Column) -> Column:
    return F.regexp_replace(empty_for_null(text), PLACEHOLDER, "")


def is_garbled(text: Column) -> Column:
    """Empty, with U+FFFD, or more than 35 % odd characters among the visible ones."""
    t = F.btrim(without_placeholders(text), F.lit(" \t\r\n"))
    visible = F.regexp_replace(t, r"[ \t\r\n]", "")
    return (F.length(visible) == 0) | F.contains(t, F.lit("�")) | (count(visible, ODD) > 0.35 * F.length(visible))


def is_english_prose(text: Column) -> Column:
    """Eight words and thirty letters at least, without @ or a URL."""
    t = F.btrim(without_placeholders(text), F.lit(" \t\r\n"))
    return ~F.contains(t, F.lit("@")) & ~t.rlike("https?://") & ~is_url(t) & (count(t, WORD) >= 8) & (count(t, r"\p{L}") >= 30)


def text_flow(text: Column) -> Column:
    """preserve_lines where three lines or more aren't blank, else flow."""
    lines = F.filter(F.split(empty_for_null(text), "\n"), lambda x: F.btrim(x, F.lit(" \t\r\f\x0b")) != "")
    return F.when(F.size(lines) >= 3, "preserve_lines").otherwise("flow")


def plain_text(markup: Column) -> Column:
    """Tags as spaces, white space collapsed."""
    return normalized(F.regexp_replace(empty_for_null(markup), "<[^>]+>", " "))


def last_word(text: Column) -> Column:
    return F.lower(F.coalesce(F.try_element_at(F.regexp_extract_all(text, F.lit(f"({WORD})"), 1), F.lit(-1)), F.lit("")))


def starts_like_continuation(text: Column) -> Column:
    """A lower-case start, or a joining word as the last word of the first 32 characters."""
    return let(normalized(text), lambda t: t.rlike("^[a-z]") | last_word(F.substring(t, 1, 32)).isin(*CONTINUES))


def ends_like_continuation(text: Column) -> Column:
    return let(normalized(text), lambda t: t.endswith("-") | (~t.rlike(TERMINAL) & last_word(t).isin(*ENDS_OPEN)))


def join_score(a: Column, b: Column, more: Column) -> Column:
    """Points for joining two paragraphs on neighbouring pages, as normalized; more: b starts like a continuation. -999 where one is empty."""
    ends = a.rlike(TERMINAL)
    points = [(more, 3), (ends & more, 3), (a.endswith("-") | (~ends & last_word(a).isin(*ENDS_OPEN)), 3), (a.endswith("-"), 4), (a.rlike(SOFT), 1), (last_word(a).isin(*SUSPICIOUS), 1), (~ends, 2)]
    return F.when((a == "") | (b == ""), F.lit(-999)).otherwise(sum((F.when(c, n).otherwise(0) for c, n in points), F.lit(0)))


def break_score(a: Column, b: Column, more: Column) -> Column:
    ends = F.when(a.rlike("[.!?]$"), 4).when(a.rlike(TERMINAL), 2).otherwise(0)
    return F.greatest(F.lit(0), ends - F.when(more, 3).otherwise(0) + F.when(b.rlike(HEADING), 3).otherwise(0) + F.when(b.rlike("^[A-Z]") & ~more, 1).otherwise(0))


def pair_decision(before: Column, after: Column) -> Column:
    """join, break or candidate. Texts and scores are computed once each."""
    decide = lambda j, b: F.when(j < 0, "break").when((j >= 4) & (j >= b + 2), "join").when((b >= 4) & (b >= j + 1), "break").otherwise("candidate")
    scores = lambda p: F.struct(join_score(p["a"], p["b"], p["more"]).alias("j"), break_score(p["a"], p["b"], p["more"]).alias("k"))
    pair = F.struct(normalized(before).alias("a"), normalized(after).alias("b"), starts_like_continuation(after).alias("more"))
    return let(let(pair, scores), lambda x: decide(x["j"], x["k"]))


def unescaped_dollars(x: Column) -> Column:
    """How many dollar signs no backslash precedes."""
    return F.regexp_count(empty_for_null(x), F.lit(r"(?<!\\)\$"))


def page_numbers(ranges: Column, total: Column) -> Column:
    """array<int>: the pages of a list like `1-3,7`, sorted, each once; all pages where the list is blank.

    Null for a list with a part that is no page of the document or no range of them, and for one that names no page.
    """
    part = lambda x, i: F.regexp_extract(x, r"^\s*(\d{1,9})\s*(?:-\s*(\d{1,9})\s*)?$", i)
    first = lambda x: part(x, 1).try_cast("int")
    last = lambda x: F.coalesce(part(x, 2).try_cast("int"), first(x))
    parts = F.filter(F.split(empty_for_null(ranges), ","), lambda x: F.trim(x) != "")
    good = F.forall(parts, lambda x: F.coalesce((first(x) >= 1) & (last(x) >= first(x)) & (last(x) <= total), F.lit(False)))
    pages = F.array_sort(F.array_distinct(F.flatten(F.transform(parts, lambda x: F.sequence(first(x), last(x))))))
    return F.when(F.trim(empty_for_null(ranges)) == "", F.sequence(F.lit(1), total)).when(good & (F.size(parts) > 0), pages)


def tags(x: Column) -> Column:
    """Tags trimmed, in lower case, sorted, each once, without empty ones."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(x, lambda v: F.lower(F.trim(v))), lambda v: v != "")))


def first_filled(*columns: Column) -> Column:
    """The first that isn't blank."""
    return F.coalesce(*[F.when(F.trim(c) != "", c) for c in columns])
