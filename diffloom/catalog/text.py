"""Text, lexing, patch and vocabulary queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.lex import LEX, LONG_LITERAL, STRING_START, code_lex, token_kind, word_length
from ..functions.patch import (COMMENT_AWARE, BLOCK_COMMENT, LINE_COMMENT, pack_hunks,
                               rebuild_new, rebuild_old, rebuild_single, split_patch,
                               split_patch_after_blank, strip_comments_keep_literals,
                               strip_java_comments, unpack_hunks)
from ..functions.text import (BLANK, CONNECTOR_RULES, EDGE_CHARS, PUNCTUATION, SYMBOLS, WORD_CHARS,
                              collapse, guard_end_marker, ngrams, normalize_for_match,
                              normalize_tokens_for_match, prose_tokens, rejoin_subwords,
                              strip_symbols, subword_split, with_task_prefix, words)
from ..markers import HUNK_MARKER, JAVA_KEYWORDS, pretraining_specials
from ..operators.vocabulary import build_vocab, decode, encode, ignore_labels, lookup_ids
from ..session import materialize
from .base import documents, query, sql_join, sql_lines, sql_strip, sql_words, table


def q(s: str) -> str:
    """A SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def _doc(expr):
    return lambda spark, sf: documents(spark, sf).select("doc_id", expr().alias("out"))


query("words", f"SELECT doc_id, len({sql_words('text')})::BIGINT AS n_words, "
               f"md5({sql_join(sql_words('text'), 'chr(31)')}) AS digest FROM documents")(
    lambda spark, sf: documents(spark, sf).select(
        "doc_id", F.size(words("text")).cast("long").alias("n_words"),
        F.md5(F.array_join(words("text"), "\u001f")).alias("digest")))

query("collapse_whitespace", f"SELECT doc_id, {sql_join(sql_words('text'))} AS out FROM documents")(
    _doc(lambda: collapse("text")))

query("word_frequency", f"""SELECT word, count(*) AS n FROM (
    SELECT unnest({sql_words('text')}) AS word FROM documents) GROUP BY word""")(
    lambda spark, sf: documents(spark, sf).select(F.explode(words("text")).alias("word"))
    .groupBy("word").agg(F.count("*").alias("n")))

PROSE = rf"[{WORD_CHARS}_]+(?:'[\p{{L}}]+)?|[^\t-\r\x1c-\x20\x{{a0}}{WORD_CHARS}_]"


def sql_prose(x):
    return f"regexp_extract_all({x}, {q(PROSE)})"


def sql_lex(x):
    return f"""flatten(list_transform(regexp_extract_all({x}, {q(LEX)}), lambda t:
        CASE WHEN length(t) > {LONG_LITERAL} AND regexp_matches(t, {q(STRING_START)})
             THEN {sql_prose('t')} ELSE [t] END))"""


query("prose_tokens", f"SELECT doc_id, {sql_join(sql_prose('text'), 'chr(31)')} AS out FROM documents")(
    _doc(lambda: F.array_join(prose_tokens("text"), "\u001f")))

query("code_lex", f"SELECT page_id, {sql_join(sql_lex('html'), 'chr(31)')} AS out FROM pages")(
    lambda spark, sf: table(spark, sf, "pages").select(
        "page_id", F.array_join(code_lex("html"), "\u001f").alias("out")))


def sql_subwords(x):
    word = f"regexp_replace(w, {q(PUNCTUATION)}, ' \\1 ', 'g')"
    for pat, rep in (("(_+)", " \\1 "), ("([A-Z]+)", " \\1"), ("([A-Z][a-z])", " \\1")):
        word = f"regexp_replace({word}, '{pat}', '{rep}', 'g')"
    return (f"flatten(list_transform({sql_words(x)}, lambda w: "
            f"string_split(array_to_string(list_filter(regexp_split_to_array({word}, '{BLANK}+'),"
            f" lambda v: v <> ''), ' <con> '), ' ')))")


query("subword_split", f"SELECT page_id, {sql_join(sql_subwords('html'))} AS out FROM pages")(
    lambda spark, sf: table(spark, sf, "pages").select(
        "page_id", F.array_join(subword_split("html"), " ").alias("out")))


def sql_rejoin(x, lower=True):
    for old, new in CONNECTOR_RULES:
        x = f"replace({x}, {q(old)}, {q(new)})"
    x = f"trim({x}, {q(EDGE_CHARS)})"
    return f"lower({x})" if lower else x


query("rejoin_subwords", f"""SELECT doc_id, {sql_rejoin(sql_join(sql_subwords('text')))} AS out
    FROM documents""")(_doc(lambda: F.array_join(rejoin_subwords(subword_split("text")), " ")))


def sql_normalize(x):
    return (f"regexp_replace(lower(regexp_replace({x}, '[^{WORD_CHARS} ]', '', 'g')), "
            f"'{BLANK}+', '', 'g')")


query("normalize_for_match", f"SELECT doc_id, {sql_normalize('text')} AS out FROM documents")(
    _doc(lambda: normalize_for_match("text")))

query("normalize_tokens_for_match", f"""SELECT doc_id, lower(coalesce(array_to_string(list_filter(
    {sql_words('text')}, lambda t: regexp_matches(t, '\\A[{WORD_CHARS}]+\\z')), ''), '')) AS out
    FROM documents""")(_doc(lambda: normalize_tokens_for_match(words("text"))))

query("strip_symbols", f"SELECT page_id, regexp_replace(html, {q(SYMBOLS)}, '', 'g') AS out FROM pages")(
    lambda spark, sf: table(spark, sf, "pages").select("page_id", strip_symbols("html").alias("out")))

query("task_prefix", """SELECT page_id, 'task' || ': ' ||
    replace(replace(html, '</p>', '</s>'), '</s>', '<unk>') AS out FROM pages""")(
    lambda spark, sf: table(spark, sf, "pages").select("page_id", guard_end_marker(
        with_task_prefix(F.lit("task"), F.replace("html", F.lit("</p>"), F.lit("</s>")))).alias("out")))

query("padded_ngrams", f"""WITH t AS (SELECT conv_id, turn, {sql_words('text')} AS w FROM conversations),
    p AS (SELECT conv_id, turn, ['<s>', '<s>'] || w || ['</s>', '</s>'] AS w FROM t)
    SELECT conv_id, turn, len(g)::BIGINT AS n, coalesce(array_to_string(g, '|'), '') AS out FROM (
        SELECT conv_id, turn, list_transform(range(1, len(w) - 1),
               lambda i: array_to_string(w[i:i + 2], ' ')) AS g FROM p)""")(
    lambda spark, sf: table(spark, sf, "conversations").select(
        "conv_id", "turn", ngrams(words("text"), 3, "<s>", "</s>").alias("g")).select(
        "conv_id", "turn", F.size("g").cast("long").alias("n"), F.array_join("g", "|").alias("out")))

query("ngram_totals", f"""WITH t AS (SELECT {sql_words('text')} AS w FROM documents)
    SELECT gram, count(*) AS n FROM (SELECT unnest(list_transform(range(1, len(w)),
        lambda i: array_to_string(w[i:i + 1], ' '))) AS gram FROM t) GROUP BY gram""")(
    lambda spark, sf: documents(spark, sf).select(
        F.explode(ngrams(words("text"), 2)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n")))

query("identifier_kinds", f"""WITH t AS (SELECT unnest({sql_lex('html')}) AS t FROM pages)
    SELECT kind, count(*) AS n, count(DISTINCT t) AS n_distinct FROM (SELECT t, CASE
        WHEN t IN ({', '.join(q(k) for k in JAVA_KEYWORDS)}) THEN 'keyword'
        WHEN regexp_matches(t, '\\A[\\p{{L}}_][{WORD_CHARS}_]*\\z') THEN 'identifier'
        ELSE 'other' END AS kind FROM t) GROUP BY kind""")(
    lambda spark, sf: table(spark, sf, "pages").select(F.explode(code_lex("html")).alias("t"))
    .groupBy("t").agg(F.count("*").alias("n"))
    .groupBy(token_kind("t", JAVA_KEYWORDS).alias("kind"))
    .agg(F.sum("n").alias("n"), F.count("*").alias("n_distinct")))

query("token_lengths", f"""SELECT lang, count(*) AS n, sum(len({sql_lex('text')}))::BIGINT AS tokens,
    sum(len({sql_words('text')}))::BIGINT AS words FROM documents GROUP BY lang""")(
    lambda spark, sf: documents(spark, sf).groupBy("lang").agg(
        F.count("*").alias("n"), F.sum(F.size(code_lex("text"))).alias("tokens"),
        F.sum(word_length("text")).alias("words")))

# --- patches ------------------------------------------------------------------

query("strip_java_comments", f"""WITH t AS (SELECT page_id,
    regexp_replace(html, '{BLOCK_COMMENT}|{LINE_COMMENT}', '', 'g') AS c FROM pages)
    SELECT page_id, coalesce(array_to_string(list_filter({sql_lines('c')},
        lambda ln: {sql_strip('ln')} <> ''), chr(10)), '') AS out FROM t""")(
    lambda spark, sf: table(spark, sf, "pages").select(
        "page_id", strip_java_comments("html").alias("out")))

query("strip_comments_keep_literals", f"""WITH t AS (SELECT page_id, coalesce(array_to_string(
        list_transform(regexp_extract_all(html, {q(COMMENT_AWARE)}), lambda p: CASE
            WHEN starts_with(p, '//') OR starts_with(p, '/*') THEN ' ' ELSE p END), ''), '') AS c
        FROM pages)
    SELECT page_id, coalesce(array_to_string(list_filter(string_split(c, chr(10)),
        lambda ln: NOT regexp_matches(ln, '\\A{BLANK}*\\z')), chr(10)), '') AS out FROM t""")(
    lambda spark, sf: table(spark, sf, "pages").select(
        "page_id", strip_comments_keep_literals("html").alias("out")))

# A signed form of a document: each line gets '-', '+' or ' ' by its number, every
# eleventh line none; used as hunk text.
SIGN = "(CASE i % 11 WHEN 1 THEN '-' WHEN 4 THEN '+' WHEN 7 THEN '' ELSE ' ' END)"
SIGNED = f"""signed AS (SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)),
    lambda ln, i: {SIGN} || ln), chr(10)) AS hunk FROM documents)"""


def signed(spark, sf):
    def sign(ln, i):
        k = (i + 1) % 11
        mark = F.when(k == 1, "-").when(k == 4, "+").when(k == 7, "").otherwise(" ")
        return F.concat(mark, ln)

    return documents(spark, sf).select("doc_id", F.array_join(
        F.transform(F.split("text", "\n", -1), sign), "\n").alias("hunk"))


def _sql_side(marks):
    cond = " OR ".join(f"starts_with(ln, '{m}')" for m in marks)
    return f"""coalesce(array_to_string(list_transform(list_filter(string_split(hunk, chr(10)),
        lambda ln: {cond}), lambda ln: substr(ln, 2)), chr(10)), '')"""


query("rebuild_sides", f"""WITH {SIGNED} SELECT doc_id, {_sql_side('- ')} AS old, {_sql_side('+ ')} AS new
    FROM signed""")(lambda spark, sf: signed(spark, sf).select(
        "doc_id", rebuild_old("hunk").alias("old"), rebuild_new("hunk").alias("new")))


def _sql_single(compat):
    minus_old = "[substr(ln, 2), substr(ln, 2)]" if compat else "[substr(ln, 2)]"
    minus_new = "[substr(ln, 2)]" if compat else "[]::VARCHAR[]"
    return f"""WITH {SIGNED}, l AS (SELECT doc_id, string_split(hunk, chr(10)) AS ls FROM signed)
    SELECT doc_id, coalesce(array_to_string(flatten(list_transform(ls, lambda ln: CASE
        WHEN starts_with(ln, '+') THEN []::VARCHAR[] WHEN starts_with(ln, '-') THEN {minus_old}
        ELSE [substr(ln, 2)] END)), chr(10)), '') AS old,
    coalesce(array_to_string(flatten(list_transform(ls, lambda ln: CASE
        WHEN starts_with(ln, '-') THEN {minus_new} ELSE [substr(ln, 2)] END)), chr(10)), '') AS new
    FROM l"""


def _single(compat):
    return lambda spark, sf: signed(spark, sf).select(
        "doc_id", rebuild_single("hunk", compat).alias("s")).select("doc_id", "s.old", "s.new")


query("rebuild_single_hunk", _sql_single(False))(_single(False))
query("rebuild_single_hunk_compat", _sql_single(True))(_single(True))

# Hunks of a document: its sentences, so that packing has several parts.
query("pack_hunks", f"""SELECT doc_id, array_to_string(h, chr(10) || '{HUNK_MARKER}' || chr(10)) AS packed,
    len(h)::BIGINT AS n FROM (SELECT doc_id, string_split(text, '. ') AS h FROM documents)""")(
    lambda spark, sf: documents(spark, sf).select(
        "doc_id", pack_hunks(F.split("text", "\\. ", -1)).alias("packed")).select(
        "doc_id", "packed", F.size(unpack_hunks("packed")).cast("long").alias("n")))


def _sql_patch_side(drop):
    return f"""array_to_string(list_filter(list_transform(list_filter(string_split(body, chr(10)),
        lambda ln: NOT starts_with(ln, '{drop}')), lambda ln: CASE WHEN starts_with(ln, '-')
        OR starts_with(ln, '+') OR starts_with(ln, ' ') THEN substr(ln, 2) ELSE ln END),
        lambda ln: replace(ln, ' ', '') <> ''), chr(10))"""


# Every document is a patch with a head; unchanged ones have no sides.
query("split_patch", f"""WITH {SIGNED}, p AS (SELECT doc_id, hunk AS body FROM signed),
    s AS (SELECT doc_id, coalesce({_sql_patch_side('+')}, '') AS old, coalesce({_sql_patch_side('-')}, '') AS new FROM p)
    SELECT doc_id, CASE WHEN old <> new THEN old END AS old, CASE WHEN old <> new THEN new END AS new FROM s""")(
    lambda spark, sf: signed(spark, sf).select("doc_id", split_patch(F.concat(
        F.lit("@@ -1,2 +3,4 @@\n"), "hunk")).alias("p")).select("doc_id", "p.old", "p.new"))

query("split_patch_after_blank", f"""WITH {SIGNED}, p AS (SELECT doc_id, hunk AS body FROM signed)
    SELECT doc_id, coalesce({_sql_patch_side('+')}, '') AS old, coalesce({_sql_patch_side('-')}, '') AS new FROM p""")(
    lambda spark, sf: signed(spark, sf).select("doc_id", split_patch_after_blank(F.concat(
        F.lit("x @@\n\n"), "hunk")).alias("p")).select("doc_id", "p.old", "p.new"))

# --- vocabulary ---------------------------------------------------------------

VOCAB = 500
SPECIALS = pretraining_specials()
_N = len(SPECIALS)
_SPECIAL_ROWS = ", ".join(f"({q(t)}, {i})" for i, t in enumerate(SPECIALS))
SQL_VOCAB = f"""tok AS (SELECT doc_id, {sql_words('text')} AS w FROM documents),
    vocab AS (SELECT token, id FROM (VALUES {_SPECIAL_ROWS}) v(token, id) UNION ALL
        SELECT token, (row_number() OVER (ORDER BY n DESC, token) + {_N - 1})::INTEGER FROM (
            SELECT token, count(*) AS n FROM (SELECT unnest(w) AS token FROM tok)
            WHERE token NOT IN ({', '.join(q(t) for t in SPECIALS)})
            GROUP BY token ORDER BY n DESC, token LIMIT {VOCAB}))"""
PAD_ID, EOS_ID, UNK_ID = (SPECIALS.index(t) for t in ("<pad>", "</s>", "<unk>"))
LENGTH = 130


def _vocab(spark, sf, written=False):
    """Tokens and their vocabulary; written once where it is looked up more than once."""
    docs = documents(spark, sf).select("doc_id", words("text").alias("w"))
    vocab = build_vocab(docs, "w", VOCAB, SPECIALS)
    return docs, materialize(vocab, "vocabulary") if written else vocab


query("build_vocab", f"WITH {SQL_VOCAB} SELECT token, id FROM vocab")(
    lambda spark, sf: _vocab(spark, sf)[1])

# Looking a token up with the row's own list keeps the order; the map is the vocabulary.
_SQL_IDS = f"""ids AS (SELECT doc_id, list(coalesce(v.id, {UNK_ID}) ORDER BY pos) AS x FROM (
        SELECT doc_id, unnest(w[1:{LENGTH - 1}]) AS token, generate_subscripts(w[1:{LENGTH - 1}], 1) AS pos
        FROM tok) t LEFT JOIN vocab v ON v.token = t.token GROUP BY doc_id),
    enc AS (SELECT tok.doc_id, list_resize(coalesce(x, []) || [{EOS_ID}], {LENGTH}, {PAD_ID}) AS ids
        FROM tok LEFT JOIN ids ON ids.doc_id = tok.doc_id)"""

query("encode", f"""WITH {SQL_VOCAB}, {_SQL_IDS} SELECT doc_id, array_to_string(ids, ' ') AS ids,
    list_sum(list_transform(ids, lambda i: CASE WHEN i <> {PAD_ID} THEN 1 ELSE 0 END))::BIGINT AS live
    FROM enc""")(
    lambda spark, sf: (lambda docs, vocab: encode(docs, "doc_id", "w", vocab, LENGTH, SPECIALS).select(
        "doc_id", F.array_join(F.transform("ids", lambda i: i.cast("string")), " ").alias("ids"),
        F.aggregate("mask", F.lit(0).cast("long"), lambda a, x: a + x).alias("live")))(*_vocab(spark, sf)))

# Labels of rows that are not trained on: one ignored label per id of the row.
query("ignore_labels", f"""WITH {SQL_VOCAB}, {_SQL_IDS} SELECT doc_id, array_to_string(list_transform(ids, lambda x: -100), ' ') AS labels
    FROM enc""")(
    lambda spark, sf: (lambda docs, vocab: encode(docs, "doc_id", "w", vocab, LENGTH, SPECIALS).select(
        "doc_id", F.array_join(F.transform(ignore_labels("ids"), lambda x: x.cast("string")), " ").alias("labels")))(
        *_vocab(spark, sf)))

# Round trip of whole texts: what decoding returns is the text's own known words.
query("decode", f"""WITH {SQL_VOCAB} SELECT doc_id, coalesce(string_agg(t.token, ' ' ORDER BY pos)
        FILTER (v.id >= {_N}), '') AS out FROM (
        SELECT doc_id, unnest(w || ['</s>']) AS token, generate_subscripts(w || ['</s>'], 1) AS pos FROM tok) t
    LEFT JOIN vocab v ON v.token = t.token GROUP BY doc_id""")(
    lambda spark, sf: (lambda docs, vocab: decode(
        lookup_ids(docs, "doc_id", "w", vocab, SPECIALS), "doc_id", "ids", vocab, SPECIALS)
        .select("doc_id", F.array_join("tokens", " ").alias("out")))(*_vocab(spark, sf, written=True)))

