"""Column functions over texts and decks (line-oriented programs), with Python's idea of lines and white space."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What str.strip() and str.split() take for space, and what str.splitlines() takes for a line end.
SPACE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
ENDS = r"\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029"
#: Patterns of any number of spaces, and of other characters. Those that most texts are made of come first: the whole class takes ten times as long.
SPACES, WORD = rf" *+[{SPACE}]*", rf"[!-~]*+[^{SPACE}]*"
#: The marks around a scratchpad, and the comment mark.
OPEN, CLOSE = "<think>", "</think>"
COMMENT = "//"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """body(value), value computed once: a lambda variable is not copied into its uses."""
    return F.transform(F.array(value), body)[0]


def strip(c: Column | str) -> Column:
    return F.regexp_replace(col(c), rf"\A[{SPACE}]+|[{SPACE}]+\z", "")


def _ends_plainly(c: Column) -> Column:
    """True if \n is the only line end in a text: then no pattern is needed to cut it."""
    return ~reduce(or_, [F.contains(c, F.lit(x)) for x in "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"])


def raw_lines(c: Column | str) -> Column:
    """Lines with their ends."""
    c = col(c)

    def plain(parts: Column) -> Column:
        ended = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda x: F.concat(x, F.lit("\n")))
        last = F.element_at(parts, -1)
        return F.when(last == "", ended).otherwise(F.concat(ended, F.array(last)))

    other = F.regexp_extract_all(c, F.lit(rf"([^{ENDS}]*(?:\r\n|[{ENDS}])|[^{ENDS}]+)"), F.lit(1))
    return F.when(_ends_plainly(c), let(F.split(c, "\n", -1), plain)).otherwise(other)


def cut_lines(c: Column | str) -> Column:
    """Lines, with their ends or without: in plain texts one cut, with an empty line after a final end."""
    return F.when(_ends_plainly(col(c)), F.split(col(c), "\n", -1)).otherwise(raw_lines(c))


def lines(c: Column | str) -> Column:
    """Lines without their ends; no empty one after a final end."""
    return F.transform(raw_lines(c), lambda x: F.regexp_replace(x, rf"(?:\r\n|[{ENDS}])\z", ""))


def first_word(line: Column | str) -> Column:
    """The comment mark for a comment, else the first token; empty for a blank line."""
    return F.regexp_extract(col(line), rf"\A{SPACES}({COMMENT}|{WORD})", 1)


def kind_of(line: Column | str) -> Column:
    """Null for a blank line, the comment mark for a comment, else the first token."""
    return F.nullif(first_word(line), F.lit(""))


def named(rest: Column | str) -> Column:
    """Of what follows a kind the space and the name after it; empty without a name."""
    return F.regexp_extract(col(rest), rf"\A{SPACES}(?=[^{SPACE}]){WORD}", 0)


def kinds(deck: Column | str) -> Column:
    """Kinds of the statements in order; blank lines and comments have none."""
    c = col(deck)
    cut = F.when(_ends_plainly(c), F.split(c, "\n", -1)).otherwise(raw_lines(c))  # line ends are space to kind_of()
    kept = F.filter(F.transform(cut, kind_of), lambda k: k.isNotNull() & (k != COMMENT))
    return F.coalesce(kept, F.array().cast("array<string>"))


def kind_set(deck: Column | str) -> Column:
    return F.array_distinct(kinds(deck))


def signature(deck: Column | str) -> Column:
    """The sorted distinct kinds, joined by commas."""
    return F.array_join(F.array_sort(kind_set(deck)), ",")


def signature_fine(deck: Column | str) -> Column:
    """All kinds in order, joined by commas."""
    return F.array_join(kinds(deck), ",")


def kinds_in(sig: Column | str) -> Column:
    """Distinct pieces of a signature; an empty one has the empty piece."""
    return F.array_distinct(F.split(col(sig), ","))


def hash32(c: Column | str) -> Column:
    """The first 32 bits of the SHA-1."""
    return F.conv(F.substring(F.sha1(col(c).cast("binary")), 1, 8), 16, 10).cast("bigint")


def bucket(c: Column | str, n: int = 100) -> Column:
    return hash32(c) % n


def without_scratchpad(c: Column | str) -> Column:
    """Closed scratchpads and the space after them are cut out."""
    return strip(F.regexp_replace(col(c), rf"(?s){OPEN}.*?{CLOSE}[{SPACE}]*", ""))


def after_last_close(c: Column | str) -> Column:
    return strip(F.substring_index(col(c), CLOSE, -1))


def close_offset(c: Column | str) -> Column:
    """Where the deck begins: after the first closing mark, else 0."""
    at = F.instr(col(c), CLOSE)
    return F.when(at > 0, at + len(CLOSE) - 1).otherwise(0)


def after_first_close(c: Column | str) -> Column:
    return F.substring(col(c), close_offset(c) + 1, F.length(col(c)))


def until_solve(c: Column | str) -> Column:
    """After the first closing mark, up to the first line that begins with the closing statement."""

    def cut(all_: Column) -> Column:
        hits = F.filter(F.sequence(F.lit(0), F.size(all_)), lambda i: F.coalesce(strip(F.get(all_, i)).startswith("solve "), F.lit(False)))
        return strip(F.array_join(F.slice(all_, 1, F.coalesce(F.get(hits, F.lit(0)) + 1, F.size(all_))), "\n"))

    whole = let(strip(after_first_close(c)), lambda t: F.when(~F.contains(t, F.lit("solve ")) & _ends_plainly(t), t).otherwise(let(lines(t), cut)))
    return whole  # a text without the statement and with plain line ends is not taken apart


def first_difference(a: Column | str, b: Column | str) -> Column:
    """Offset of the first character that differs; the lesser length if none does.

    Found by halving: of equal beginnings the longest, in 31 steps whatever the length."""
    a, b = col(a), col(b)

    def step(low: Column, k: Column) -> Column:
        tried = low + F.pow(F.lit(2), k).cast("int")
        same = (tried <= F.least(F.length(a), F.length(b))) & (F.substr(a, low + 1, tried - low) == F.substr(b, low + 1, tried - low))
        return F.when(same, tried).otherwise(low)

    return F.when(a.isNotNull() & b.isNotNull(), F.aggregate(F.sequence(F.lit(30), F.lit(0)), F.lit(0), step))


def basename(c: Column | str) -> Column:
    return F.element_at(F.split(F.rtrim(col(c), F.lit("/")), "/"), -1)


def without_eos(c: Column | str, eos: str) -> Column:
    return strip(F.replace(col(c), F.lit(eos), F.lit("")))
