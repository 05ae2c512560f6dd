"""Line-first quality rules, in DataFrame functions only.

Every line is judged by itself: it has to end like a sentence, must not be a navigation bar, a run of symbols, shouted,
or boilerplate. Lines that fail go; a document that lost too large a part of its text goes as a whole.
All of it works inside one row, so there is no shuffle at all and no group can grow hot.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, WORD, fresh, words

#: What marks boilerplate lines, lower case.
BOILERPLATE = (
    "all rights reserved",
    "terms of service",
    "terms of use",
    "privacy policy",
    "cookie policy",
    "we use cookies",
    "enable javascript",
    "click here to",
    "sign up for our newsletter",
    "subscribe to our newsletter",
    "lorem ipsum",
    "licensed under",
    "alle rechte vorbehalten",
    "tous droits réservés",
    "todos los derechos reservados",
)


@dataclass(frozen=True)
class LineRules:
    """Limits of the line rules. A line with fewer than min_words words needs no closing mark (titles, list items)."""

    min_words: int = 6
    symbols_per_word: float = 0.3
    separators_per_word: float = 0.2
    separators: int = 3
    marks_per_word: float = 0.5
    max_lost: float = 0.5


SYMBOLS, BARS, MARKS = "#*$%&<>", "|»›·•", "!?"
#: Marks that end a sentence, and what may stand after them.
ENDS, AFTER = (".", "!", "?", "…", ":", ";", "。", "！", "？"), " \t\n\x0b\x0c\r\"'”’»)]"


def count_of(text: Column, chars: str) -> Column:
    """How many characters of a text are among those given; plain byte searches, far cheaper than a pattern."""
    rest = text
    for c in chars:
        rest = F.replace(rest, F.lit(c))
    return F.length(text) - F.length(rest)


def has_any(text: Column, chars: str) -> Column:
    return reduce(or_, (F.contains(text, F.lit(c)) for c in chars))


def line_ok(line: Column, marked: Column, boilerplate: Column, rules: LineRules) -> Column:
    """marked, boilerplate: whether anything of that kind is in the whole text; most texts spare their lines the costly rules."""
    n = F.size(F.array_remove(F.split(line, WHITE), ""))
    symbols, bars, marks = (count_of(line, x) for x in (SYMBOLS, BARS, MARKS))
    ended = F.right(F.rtrim(line, F.lit(AFTER)), F.lit(1)).isin(*ENDS)
    noisy = (symbols > rules.symbols_per_word * n) | ((bars >= rules.separators) & (bars > rules.separators_per_word * n)) | ((n >= rules.min_words) & (marks > rules.marks_per_word * n))
    phrase = reduce(or_, (F.contains(F.lower(line), F.lit(x)) for x in BOILERPLATE))
    return (ended | (n < rules.min_words)) & ~(marked & noisy) & ~(boilerplate & phrase)


def clean_lines(docs: DataFrame, text: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """Adds clean_text, n_lines (with a word), n_lines_removed, lost (share of the lines' characters removed) and lines_ok.

    Null or empty text: clean_text keeps the null or empty text, 0 lines, lost 0, lines_ok true (nothing was lost;
    refusing empty documents is the caller's rule). Lines without a word are dropped and not counted. Very long texts
    are whole: no prefix is judged. Repeated rows are judged alike. Extra columns stay; a column named like one
    that is added is replaced.
    """
    lines, good, marked, phrase = fresh(docs, "lines_", "good_", "marked_", "phrase_")
    t = F.coalesce(F.col(text), F.lit(""))
    low = F.lower(t)
    out = docs.withColumns({lines: F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD)), marked: has_any(t, SYMBOLS + BARS + MARKS), phrase: reduce(or_, (F.contains(low, F.lit(x)) for x in BOILERPLATE))})
    out = out.withColumn(good, F.filter(lines, lambda x: line_ok(x, F.col(marked), F.col(phrase), rules)))
    weigh = lambda c: F.length(F.array_join(c, ""))
    lost = F.when(F.size(lines) == 0, F.lit(0.0)).otherwise(1.0 - F.try_divide(weigh(good).cast("double"), weigh(lines).cast("double")))
    clean = F.when(F.col(text).isNull() | (F.size(lines) == 0), F.col(text)).otherwise(F.array_join(good, "\n"))
    out = out.withColumns({"clean_text": clean, "n_lines": F.size(lines).cast("long"), "n_lines_removed": (F.size(lines) - F.size(good)).cast("long"), "lost": lost})
    return out.withColumn("lines_ok", F.col("lost") <= rules.max_lost).drop(lines, good, marked, phrase)


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (all long) and base_failed.

    Null text has no words and no lines. A word is counted once in n_repeat_words however many repeated windows hold it.
    """
    w, lines, keys, places, grams, twice = fresh(docs, "w_", "lines_", "keys_", "places_", "grams_", "twice_")
    t = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumns({w: words(F.col(text)), lines: F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))})
    word = lambda i: F.get(F.col(w), i)
    out = out.withColumn(keys, F.when(F.size(w) >= 4, F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(word(i), word(i + 1), word(i + 2)))))
    # if digests repeat: the windows whose digest does, themselves and with their places, sorted so that equal windows are neighbours
    at = lambda i: F.concat_ws(" ", word(i), word(i + 1), word(i + 2))
    out = out.withColumn(places, F.when(F.size(F.array_distinct(keys)) < F.size(keys), F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("p"))))))
    twin = lambda x, i: x["k"] == F.get(F.col(places), i)["k"]
    near = F.filter(places, lambda x, i: twin(x, i - 1) | twin(x, i + 1))
    out = out.withColumn(grams, F.sort_array(F.transform(near, lambda x: F.struct(at(x["p"]).alias("g"), x["p"].alias("p")))))
    same = lambda x, i: x["g"] == F.get(F.col(grams), i)["g"]
    out = out.withColumn(twice, F.filter(grams, lambda x, i: same(x, i - 1) | same(x, i + 1)))
    covered = F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["p"], x["p"] + 1, x["p"] + 2)))))
    out = out.withColumns({
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(t, "[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": F.when(F.size(twice) > 0, covered).otherwise(0).cast("long"),
    })
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed).drop(w, lines, keys, places, grams, twice)


def quality(docs: DataFrame, text: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """base_counts and clean_lines, and kept: neither the base nor the line rules refuse the document."""
    out = clean_lines(base_counts(docs, text), text, rules)
    return out.withColumn("kept", ~F.col("base_failed") & F.col("lines_ok"))
