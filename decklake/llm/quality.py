"""Quality rules by line-first cleaning, with DataFrame expressions only.

Each line is judged by itself (symbols, shouting, end punctuation, navigation, boilerplate); failing lines are
removed, and a document is rejected if it loses too much of its text that way or fails the base rules. All work
on a document stays in its row: no shuffle, so hot sources or copies cost nothing extra.

Edge cases: a null text counts as empty (no words: rejected); lines without a word are kept and never counted;
very long texts take n log n steps; other columns pass through untouched unless they carry an output's name,
in which case the output replaces them; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, count_chars, fresh, let, text_of, words_of

#: The base rules.
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

#: The line rules.
END_MARKS = (".", "!", "?", ":", ";", "…", '"', "'", "”", "’", "»", ")", "]", "。", "！", "？", "।", "॥", "؟", "۔", "։", "።", "။", "។", "｡", "．", "」", "』")
INNER_END = r"[.!?][\x20\x09-\x0D]"
SEPARATORS = "|»›•·"
BOILERPLATE = (
    "licensed under", "released under", "all rights reserved", "copyright", "javascript", "cookie", "privacy policy",
    "terms of use", "terms of service", "lorem ipsum", "click here", "sign up", "log in", "subscribe",
    "alle rechte vorbehalten", "datenschutz", "impressum", "nutzungsbedingungen", "hier klicken", "jetzt anmelden",
    "tous droits réservés", "mentions légales", "cliquez ici", "se connecter",
    "todos los derechos reservados", "aviso legal", "haga clic", "política de privacidad", "iniciar sesión",
)
#: A phrase counts where it and the line's other phrases are at least a LEAST_SHARE-th of a line of at most SHORT_LINE characters.
SHORT_LINE, LEAST_SHARE = 200, 4
PHRASE = r"(?<![A-Za-z0-9_])(?:" + "|".join(BOILERPLATE) + r")s?(?![A-Za-z0-9_])"
MAX_LOST_PERCENT = 50


def repeat_words(words: Column) -> Column:
    """Words that lie in a window of WINDOW words which the text holds twice or more, the first time included."""

    def covered(places: Column) -> Column:
        start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(
            places, start, lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n")), lambda acc: acc["n"]
        )

    def repeated(keyed: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(keyed, k)["h"] == x["h"], F.lit(False))
        twice = F.filter(keyed, lambda x, k: same(x, k - 1) | same(x, k + 1))
        return covered(F.sort_array(F.transform(twice, lambda x: x["i"])))

    def of(hashes: Column) -> Column:
        keyed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(keyed, repeated))

    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(let(hashes, of))


def says_boilerplate(line: Column) -> Column:
    """True for a short line that boilerplate phrases, as whole words, make up a large part of."""
    said = lambda low: F.length(F.array_join(F.regexp_extract_all(low, F.lit(PHRASE), F.lit(0)), ""))
    return (F.length(line) <= SHORT_LINE) & (LEAST_SHARE * let(F.lower(line), said) >= F.length(line))


def line_fails(line: Column) -> Column:
    """True for a line that a rule removes: no sentence's end, symbols, separators, shouting or boilerplate.

    A paragraph whose last sentence lacks its mark is no fragment: an end inside the line will do."""
    end = F.substring(F.rtrim(line, F.lit(SPACES)), -1, 1)
    marked = line.rlike("[" + (SYMBOLS + SEPARATORS + "!").replace("|", "\\|") + "]") & (
        (10 * count_chars(line, SYMBOLS) > F.length(line))
        | (count_chars(line, SEPARATORS) >= 2)
        | (12 * count_chars(line, "!") > F.length(line))
    )
    fragment = ~end.isin(*END_MARKS) & ~line.rlike(INNER_END)
    return fragment | marked | says_boilerplate(line)


def judge(docs: DataFrame, text: str = "text", max_lost_percent: int = MAX_LOST_PERCENT) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lost_chars (long), base_failed, kept (boolean) and clean_text."""
    whole = text_of(text)
    has_word = lambda line: line.rlike(r"[^\x20\x09-\x0D]")

    def of_lines(lines: Column) -> Column:
        return let(
            F.transform(lines, lambda x: F.struct(x.alias("line"), (has_word(x) & line_fails(x)).alias("fails"))),
            lambda marked: F.struct(
                F.array_join(F.transform(F.filter(marked, lambda m: ~m["fails"]), lambda m: m["line"]), "\n").alias("clean_text"),
                F.aggregate(F.filter(marked, lambda m: m["fails"]), F.lit(0), lambda acc, m: acc + F.length(m["line"])).alias("lost"),
                let(F.filter(lines, has_word), lambda full: F.size(full) - F.size(F.array_distinct(full))).alias("dup"),
            ),
        )

    def of_words(words: Column) -> Column:
        return F.struct(F.size(words).alias("n"), F.length(F.array_join(words, "")).alias("chars"), repeat_words(words).alias("rep"))

    w, x = fresh(docs, "w", "l")
    out = docs.withColumn(w, let(words_of(whole), of_words)).withColumn(x, let(F.split(whole, "\n"), of_lines))
    long = lambda c: c.cast("long")
    out = out.withColumns(
        {
            "n_words": long(F.col(w)["n"]),
            "word_chars": long(F.col(w)["chars"]),
            "n_symbols": long(count_chars(whole, SYMBOLS)),
            "n_dup_lines": long(F.col(x)["dup"]),
            "n_repeat_words": long(F.col(w)["rep"]),
            "lost_chars": long(F.col(x)["lost"]),
            "clean_text": F.col(x)["clean_text"],
        }
    ).drop(w, x)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (100 * F.col("lost_chars") <= max_lost_percent * F.length(whole)))
