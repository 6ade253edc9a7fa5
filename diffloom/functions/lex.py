"""A regex lexer for code-like text and token measures built on it."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import as_col
from .text import WORD_CHARS, prose_tokens

# One alternation, first match wins.  It holds for Java and RE2 alike: no lookaround,
# literals unrolled so that long ones need no recursion.
STRING_PREFIX = r"(?:[bBrRuUfF]|[bB][rR]|[rR][bB]|[fF][rR]|[rR][fF])?"
STRINGS = [
    STRING_PREFIX + r'"""(?s:.*?)"""',
    STRING_PREFIX + r"'''(?s:.*?)'''",
    STRING_PREFIX + r'"[^"\\\n]*(?:\\(?s:.)[^"\\\n]*)*"',
    STRING_PREFIX + r"'[^'\\\n]*(?:\\(?s:.)[^'\\\n]*)*'",
]
NUMBER = (r"0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+"
          r"|(?:[0-9][0-9_]*(?:\.[0-9_]*)?|\.[0-9][0-9_]*)(?:[eE][-+]?[0-9]+)?[jJ]?")
NAME = rf"[{WORD_CHARS}_]+"
OPERATORS = (r"\*\*=|//=|>>=|<<=|\.\.\.|!=|%=|&=|\*\*|\*=|\+=|-=|->|//|/=|:=|<<|<=|==|>=|>>"
             r"|@=|\^=|\|=")
LEX = "|".join([r"(?m:^ +)", *STRINGS, r"#[^\r\n]*", NUMBER, NAME, r"\r?\n", r"\t",
                OPERATORS, r"[^\t-\r\x1c-\x20]"])
STRING_START = rf"""\A{STRING_PREFIX}["']"""
LONG_LITERAL = 20


def raw_lex(c) -> Column:
    return F.regexp_extract_all(as_col(c), F.lit(LEX), F.lit(0))


def code_lex(c) -> Column:
    """Names, numbers, literals, operators, line ends, indents, tabs.

    A string literal longer than 20 characters is read as prose.
    """
    return F.flatten(F.transform(
        raw_lex(c),
        lambda t: F.when((F.length(t) > LONG_LITERAL) & t.rlike(STRING_START), prose_tokens(t))
        .otherwise(F.array(t))))


def token_length(c) -> Column:
    return F.size(code_lex(c))


def word_length(c) -> Column:
    from .text import words

    return F.size(words(c))


def token_kind(token, keywords: list[str]) -> Column:
    """``keyword``, ``identifier`` or ``other``."""
    t = as_col(token)
    return (F.when(t.isin(keywords), "keyword")
            .when(t.rlike(r"\A[\p{L}_]" + rf"[{WORD_CHARS}_]*\z"), "identifier")
            .otherwise("other"))
