"""Text and token-array expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import as_col, let
from .draws import numbers

# The whitespace and line-break code points of Python's str methods,
# spelled out so that every regex engine splits at the same places.
BLANK = (r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
         r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
# The same blanks for the JVM, in two tests a character.
JVM_BLANK = r"[\x1c-\x1f\p{IsWhite_Space}]"
LINE_BREAK = r"\r\n|[\n-\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"
WORD_CHARS = r"\p{L}\p{N}"

# Punctuation isolated before subword splitting.
PUNCTUATION = r"""([-!"#$%&'()*+,./:;<=>?@\[\\\]^`{|}~])"""

# Symbols removed by strip_symbols.
SYMBOLS = r"""[~!@#$%^&*()_+\-=\[\]{}|;:'"<,>.?/]"""

# Connector clean-up, applied in this order.
CONNECTOR = "<con>"
CONNECTOR_RULES = [
    (" <con> ,", " ,"), (" <con> #", " #"), (" <con> (", " ("), ("( <con> ", "( "),
    (" <con> )", " )"), (") <con> ", ") "), (" <con> {", " {"), (" <con> }", " }"),
    (" <con> @", " @"), ("# <con> ", "# "), (" <con> ", ""),
]
EDGE_CHARS = " !\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def words(c) -> Column:
    """Whitespace words, empties dropped."""
    return F.filter(F.split(as_col(c), JVM_BLANK + "+", -1), lambda w: w != "")


def collapse(c) -> Column:
    """Every whitespace run becomes one space; ends are trimmed."""
    return F.array_join(words(c), " ")


def strip(c) -> Column:
    return F.regexp_replace(as_col(c), rf"\A{BLANK}+|{BLANK}+\z", "")


def is_blank(c) -> Column:
    return strip(c) == ""


def lines(c) -> Column:
    """Lines without their ends; no empty last line after a final break."""
    return let(lambda p: F.when(
        F.element_at(p, -1) == "", F.slice(p, F.lit(1), F.size(p) - 1)).otherwise(p),
        F.split(as_col(c), LINE_BREAK, -1))


def first_line(c) -> Column:
    return F.substring_index(as_col(c), "\n", 1)


def prose_tokens(c) -> Column:
    """Words (with an inner apostrophe kept) and single punctuation marks."""
    pattern = rf"[{WORD_CHARS}_]+(?:'[\p{{L}}]+)?|[^\t-\r\x1c-\x20\x{{a0}}{WORD_CHARS}_]"
    return F.regexp_extract_all(as_col(c), F.lit(pattern), F.lit(0))


def subword_split(c) -> Column:
    """Words split at punctuation, underscores and case changes, parts joined by ``<con>``."""

    def pieces(word: Column) -> Column:
        spaced = F.regexp_replace(word, PUNCTUATION, " $1 ")
        spaced = F.regexp_replace(spaced, "(_+)", " $1 ")
        spaced = F.regexp_replace(spaced, "([A-Z]+)", " $1")
        spaced = F.regexp_replace(spaced, "([A-Z][a-z])", " $1")
        return F.split(F.array_join(words(spaced), f" {CONNECTOR} "), " ", -1)

    return F.flatten(F.transform(words(c), pieces))


def rejoin_subwords(tokens, lower: bool = True) -> Column:
    """Undo ``subword_split`` the way scores expect it: clean, trim, split at spaces."""
    text = F.array_join(as_col(tokens), " ")
    for old, new in CONNECTOR_RULES:
        text = F.replace(text, F.lit(old), F.lit(new))
    text = F.btrim(text, F.lit(EDGE_CHARS))
    return F.split(F.lower(text) if lower else text, " ", -1)


def normalize_for_match(c) -> Column:
    """Letters and digits only, lower case, no spaces."""
    kept = F.regexp_replace(as_col(c), rf"[^{WORD_CHARS} ]", "")
    return F.regexp_replace(F.lower(kept), BLANK + "+", "")


def normalize_tokens_for_match(tokens) -> Column:
    """Token-array form: only fully alphanumeric tokens count."""
    kept = F.filter(as_col(tokens), lambda t: t.rlike(rf"\A[{WORD_CHARS}]+\z"))
    return F.lower(F.array_join(kept, ""))


def strip_symbols(c) -> Column:
    return F.regexp_replace(as_col(c), SYMBOLS, "")


def guard_end_marker(c) -> Column:
    """The end marker may occur only once per encoded row, so text may not carry it."""
    return F.replace(as_col(c), F.lit("</s>"), F.lit("<unk>"))


def with_task_prefix(task, c) -> Column:
    return F.concat(as_col(task), F.lit(": "), as_col(c))


def ngrams(tokens, n: int, pad_left: str | None = None, pad_right: str | None = None,
           sep: str = " ") -> Column:
    """All runs of ``n`` tokens as joined strings; empty when there are fewer tokens."""
    t = as_col(tokens)
    if pad_left is not None and n > 1:
        t = F.concat(F.array_repeat(F.lit(pad_left), n - 1), t)
    if pad_right is not None and n > 1:
        t = F.concat(t, F.array_repeat(F.lit(pad_right), n - 1))
    return let(lambda t: F.transform(numbers(F.size(t) - (n - 1)),
                                     lambda i: F.array_join(F.slice(t, i, F.lit(n)), sep)), t)
