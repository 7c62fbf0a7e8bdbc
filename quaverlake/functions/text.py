"""Text forms as column expressions: normalising, skeletons, trigrams, spans, spoken keys and similarities."""

from __future__ import annotations

import unicodedata

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _folding() -> tuple[str, str]:
    """Composed characters of the basic plane and their base, where one base and non-spacing marks are all they are made of."""
    pairs = []
    for code in range(0xC0, 0xFFFF):
        parts = unicodedata.normalize("NFD", chr(code)) if not 0xD800 <= code < 0xE000 else ""
        base = [x for x in parts if unicodedata.category(x) != "Mn"]
        if len(parts) > 1 and len(base) == 1:
            pairs.append((chr(code), base[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_COMPOSED, _BASES = _folding()
#: Letters that are written out.
LETTERS = {"ð": "d", "Ð": "d", "þ": "th", "Þ": "th", "ı": "i", "ł": "l", "Ł": "l", "ø": "o", "Ø": "o", "æ": "ae", "Æ": "ae", "œ": "oe", "Œ": "oe", "ß": "ss"}
#: How letters and digits are spoken.
LETTER_NAMES = {
    "a": "ay", "b": "bee", "c": "see", "d": "dee", "e": "ee", "f": "ef", "g": "gee", "h": "aitch", "i": "eye", "j": "jay", "k": "kay", "l": "el", "m": "em",
    "n": "en", "o": "oh", "p": "pee", "q": "cue", "r": "ar", "s": "ess", "t": "tee", "u": "you", "v": "vee", "w": "doubleyou", "x": "ex", "y": "why", "z": "zed",
}
DIGIT_NAMES = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"]
#: Sounds that the skeleton treats alike, in the order in which they are replaced.
SOUNDS = [("ph", "f"), ("ght", "t"), ("ck", "k"), ("qu", "k"), ("sh", "s"), ("ch", "c"), ("th", "t")]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value worked out once a row, also where the body uses it in a lambda of its own, as every call of a lambda would work it out anew."""
    return F.transform(F.array(value), body)[0]


def normalise(c: Column) -> Column:
    """Lower-case words of letters and digits, without marks, one space apart; null and blank give ''.

    Characters of two or more base letters that have no written-out form, such as Hangul syllables, stay composed."""
    c = F.translate(F.coalesce(c, F.lit("")), _COMPOSED, _BASES)
    for letter, written in LETTERS.items():
        c = F.replace(c, F.lit(letter), F.lit(written))
    c = F.regexp_replace(c, r"\p{Mn}+", "")
    return F.trim(F.lower(F.regexp_replace(c, r"[^\p{L}\p{Nd}]+", " ")))


def compact(normalised: Column) -> Column:
    return F.replace(normalised, F.lit(" "), F.lit(""))


def tokens(normalised: Column) -> Column:
    return F.filter(F.split(normalised, " "), lambda t: t != "")


def skeleton(compacted: Column) -> Column:
    """Consonants, with like sounds written alike and neighbours that are equal collapsed, also across dropped vowels."""
    c = compacted
    for sound, letter in SOUNDS:
        c = F.replace(c, F.lit(sound), F.lit(letter))
    return F.regexp_replace(F.translate(c, "cqvzaeiouy", "kkfs"), r"(.)\1+", "$1")


def expand_digits(normalised: Column) -> Column:
    c = normalised
    for digit, name in enumerate(DIGIT_NAMES):
        c = F.replace(c, F.lit(str(digit)), F.lit(f" {name} "))
    return F.trim(F.regexp_replace(c, " +", " "))


def all_trigrams(compacted: Column) -> Column:
    each = lambda c: F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substring(c, i, F.lit(3)))
    return let(compacted, lambda c: F.when(F.length(c) >= 3, each(c)).otherwise(F.array().cast("array<string>")))


def trigrams(compacted: Column) -> Column:
    return F.array_distinct(all_trigrams(compacted))


def query_spans(words: Column) -> Column:
    """Every run of words as (text, size), in the order of first words, then of sizes."""
    starts = lambda w: F.when(F.size(w) > 0, F.sequence(F.lit(1), F.size(w))).otherwise(F.array().cast("array<int>"))
    each = lambda w, i: F.transform(F.sequence(F.lit(1), F.size(w) - i + 1), lambda k: F.struct(F.array_join(F.slice(w, i, k), " ").alias("text"), k.alias("size")))
    return let(words, lambda w: F.flatten(F.transform(starts(w), lambda i: each(w, i))))


def acronym_keys(value: Column) -> Column:
    """Keys of a value that is two to six capitals: its first letter spoken and the rest as it is, and all letters spoken."""
    names = F.create_map(*[x for k, v in LETTER_NAMES.items() for x in (F.lit(k), F.lit(v))])
    low = F.lower(value)
    spoken = F.array_join(F.transform(F.split(low, ""), lambda x: names[x]), "")
    keys = F.array(F.concat(names[F.substring(low, 1, 1)], F.substring(low, 2, 5)), spoken)
    return F.when(value.rlike("^[A-Z]{2,6}$"), F.array_distinct(keys)).otherwise(F.array().cast("array<string>"))


def edit_limit(length: Column) -> Column:
    return F.when(length <= 4, 1).when(length <= 8, 2).when(length <= 16, 3).otherwise(4)


def bounded_edit(a: Column, b: Column, limit: int) -> Column:
    """The edit distance, or limit + 1 where it is larger."""
    d = F.levenshtein(a, b, limit)
    return F.when(d < 0, limit + 1).otherwise(d)


def trigram_dice(a: Column, b: Column) -> Column:
    """Of two sets; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), 2.0 * both / (F.size(a) + F.size(b))).otherwise(F.lit(0.0))


def text_forms(c: Column) -> Column:
    """normalised, compact, tokens, skeleton and trigrams of a text."""
    n = normalise(c)
    k = compact(n)
    return F.struct(n.alias("normalised"), k.alias("compact"), tokens(n).alias("tokens"), skeleton(k).alias("skeleton"), trigrams(k).alias("trigrams"))
