"""Training examples: masking objectives, mixtures and assembly.

Every builder is a column expression ``struct(input, target)`` of token arrays, so a
mixture is one projection over the edit-script table: no shuffle.  With ``batched`` masks are
drawn and collapsed in numpy over Arrow batches (``operators.masked``) instead of token by token
in lambdas.  Tokens and ops must then be columns of a table: Spark plans no Python function
whose arguments hold lambdas that use variables of outer ones, as scripts do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import as_col, let
from ..functions.draws import draw, numbers
from ..functions.lex import token_kind
from ..functions.masks import (collapse_masks, mark_tokens, message_mask, ranked_hits, sentinel,
                               span_noise_mask)
from ..functions.text import strip
from ..markers import (CHANGED_MARK, CORRUPT_TAG, GENERATE_TAG, JAVA_KEYWORDS, KEEP,
                       KEEP_SPAN_TAG, MSG_TAG, SEGMENT_TAG, STATE_TAG, UPDATED_TAG)
from ..operators.filters import STATE_TYPE
from ..operators.masked import (changed_runs, collapse_and_cut, collapse_runs, corrupt, kept_runs, noise_runs,
                                shifted)
from ..operators.scripts import edit_streams, prefix_sums, side_labels

# Shares and bands.
KEEP_SHARE, MESSAGE_SHARE = 0.3, 0.2
DELETE_BAND, INSERT_BAND = 0.495, 0.71
KEEP_SPAN_SHARE, CORRUPT_SHARE = 0.33, 0.66
TAG_KEPT, TAG_CHANGED, MASK_CHANGED = 0.2, 0.5, 0.5
SIDE_LIMIT = 250
RUNS = "array<struct<lo:int,hi:int>>"


def _tag(*names: str) -> Column:
    return F.array(*[F.lit(n) for n in names])


def lang_tag(lang) -> Column:
    return F.concat(F.lit("<"), strip(lang), F.lit(">"))


def framed(nl, lang, body) -> Column:
    """Message and code with their tags; without a message only the code part."""
    code = F.concat(F.array(lang_tag(lang)), as_col(body))
    if nl is None:
        return code
    return F.concat(_tag(MSG_TAG), as_col(nl), code)


def framed_mask(nl_mask, body_mask) -> Column:
    zero = F.array(F.lit(0))
    if nl_mask is None:
        return F.concat(zero, body_mask)
    return F.concat(zero, nl_mask, zero, body_mask)


def _head(nl) -> Column:
    """How many tokens of ``framed`` stand before the code."""
    return F.lit(1) if nl is None else F.size(as_col(nl)) + 2


def framed_runs(nl, seed: str, key, body_runs=None) -> Column:
    """Masked runs of the message, and of the code if given, as runs of ``framed``."""
    body = F.array().cast(RUNS) if body_runs is None else shifted(body_runs, _head(nl))
    if nl is None:
        return body
    n = F.size(as_col(nl))
    runs = noise_runs(F.when(n <= 5, 0).otherwise(n), MESSAGE_SHARE, seed + "-nl", key)
    return F.concat(shifted(runs, F.lit(1)), body)


def example(input_: Column, target: Column) -> Column:
    return F.struct(input_.alias("input"), target.alias("target"))


def _nl_mask(nl, seed, key):
    return None if nl is None else message_mask(F.size(as_col(nl)), seed + "-nl", key)


def kept_span_mask(ops, seed: str, key) -> Column:
    """Mask over old tokens: spans of kept tokens only, 30 % of them."""
    def kept(op):
        return F.when(op["tag"] == "equal", op["i2"] - op["i1"]).otherwise(F.lit(0))

    def build(ops, total, before):
        # Kept tokens have the mask's places in order: a part starts after all kept before it.
        return let(lambda m: F.flatten(F.zip_with(ops, before, lambda op, at: F.when(
            op["tag"] == "equal", F.slice(m, at + 1, op["i2"] - op["i1"])).otherwise(
            F.array_repeat(F.lit(0), op["i2"] - op["i1"])))),
            span_noise_mask(total, KEEP_SHARE, seed, key))

    return let(lambda ops: let(build, ops, F.aggregate(ops, F.lit(0), lambda acc, op: acc + kept(op)),
                               prefix_sums(F.transform(ops, kept))), as_col(ops))


def keep_span_example(nl, lang, old, new, ops, seed: str, key, compat: bool = False,
                      batched: bool = False) -> Column:
    """Kept code spans and message words are masked; the target is the new code.

    ``compat`` repeats published data, where the code comes out unmasked, cut to the
    length its masked form would have had.
    """
    if batched:
        tokens, runs = framed(nl, lang, old), kept_runs(ops, KEEP_SHARE, seed, key)
        if compat:
            return example(collapse_and_cut(tokens, framed_runs(nl, seed, key), shifted(runs, _head(nl)), _head(nl)), as_col(new))
        return example(collapse_runs(tokens, framed_runs(nl, seed, key, runs)), as_col(new))

    def build(old, code_mask):
        body = F.slice(old, F.lit(1), F.size(collapse_masks(old, code_mask))) if compat else old
        mask = let(lambda b: F.array_repeat(F.lit(0), F.size(b)), body) if compat else code_mask
        return example(collapse_masks(framed(nl, lang, body),
                                      framed_mask(_nl_mask(nl, seed, key), mask)), as_col(new))

    return let(build, old, kept_span_mask(ops, seed, key))


def corrupt_tokens(tokens, seed: str, key, replace: bool = False, batched: bool = False) -> Column:
    """Per token: dropped, preceded by a sentinel, or kept; at most 99 sentinels.

    ``replace`` turns the otherwise kept band into sentinels as well.
    """
    if batched:
        return corrupt(tokens, DELETE_BAND, INSERT_BAND, replace, seed, key)

    def band(u):
        return (F.when(u < DELETE_BAND, 2).when(u < INSERT_BAND, 1)
                .otherwise(3 if replace else 0))

    def build(t, bands, ranked):
        def piece(x, i):
            def place(r):
                mark = F.when(F.get(bands, i) == 3, F.array(sentinel(r))).otherwise(
                    F.array(sentinel(r), x))
                return F.when(r > 0, mark).otherwise(F.array(x))

            b = F.get(bands, i)
            return (F.when(b == 2, F.array().cast("array<string>")).when(b == 0, F.array(x))
                    .otherwise(let(place, F.array_position(ranked, i + 1))))

        return F.flatten(F.transform(t, piece))

    def ranked(bands):
        return ranked_hits(F.transform(bands, lambda b: b.isin(1, 3).cast("int")))

    bands = F.transform(as_col(tokens), lambda x, i: let(band, draw(seed, key, i + 1)))
    return let(lambda t, b: let(lambda r: build(t, b, r), ranked(b)), tokens, bands)


def corrupted_example(nl, lang, old, new, seed: str, key, replace: bool = False, batched: bool = False) -> Column:
    return example(framed(nl, lang, corrupt_tokens(old, seed, key, replace, batched)),
                   F.concat(F.array(lang_tag(lang)), as_col(new)))


def target_example(nl, lang, old, new, seed: str, key) -> Column:
    """Message and old code both lose short spans."""
    body_mask = message_mask(F.size(as_col(old)), seed + "-old", key)
    return example(collapse_masks(framed(nl, lang, old),
                                  framed_mask(_nl_mask(nl, seed, key), body_mask)), as_col(new))


def state_example(nl, lang, old, new) -> Column:
    return example(framed(nl, lang, old), as_col(new))


def identifier_example(nl, lang, old, new, keywords: list[str] = JAVA_KEYWORDS) -> Column:
    """The first 99 identifiers become sentinels."""
    flags = F.transform(as_col(old),
                        lambda t: (token_kind(t, keywords) == "identifier").cast("int"))
    return example(framed(nl, lang, mark_tokens(old, flags, replace=True)),
                   F.concat(F.array(lang_tag(lang)), as_col(new)))


def edit_tag_example(nl, lang, old, ops, seed: str, key) -> Column:
    """Sentinels before some tokens; the target says which of those tokens change."""
    def flags(labels):
        return F.transform(labels, lambda l, i: (draw(seed, key, i + 1) < F.when(
            l == 0, TAG_KEPT).otherwise(TAG_CHANGED)).cast("int"))

    def build(old, labels, flags):
        names = let(lambda hits: F.transform(hits, lambda at, r: F.concat(
            sentinel(r + 1), F.lit(":"), F.when(F.element_at(labels, at) == 0, KEEP)
            .otherwise(CHANGED_MARK))), ranked_hits(flags))
        return example(framed(nl, lang, mark_tokens(old, flags, replace=False)),
                       F.split(F.array_join(names, ", "), " ", -1))

    return let(lambda old, labels: let(lambda f: build(old, labels, f), flags(labels)),
               old, side_labels(ops, "old"))


def edit_content_example(nl, lang, old, new, ops, seed: str, key, compat: bool = False,
                         batched: bool = False) -> Column:
    """Half of the changed tokens are masked.

    ``compat`` stops at the first changed token that is drawn to stay.
    """
    if batched:
        changed = changed_runs(ops, MASK_CHANGED, seed, key, first=compat)
        return example(collapse_runs(framed(nl, lang, old), framed_runs(nl, seed, key, changed)), as_col(new))

    def mask(labels):
        if not compat:
            return F.transform(labels, lambda l, i: (
                (l != 0) & (draw(seed, key, i + 1) < MASK_CHANGED)).cast("int"))

        def prefix(changed):
            stays = F.transform(changed, lambda at, r: draw(seed, key, r + 1) >= MASK_CHANGED)
            return let(lambda s: F.when(s == 0, changed).otherwise(
                F.slice(changed, F.lit(1), s.cast("int") - 1)), F.array_position(stays, True))

        changed = F.filter(numbers(F.size(labels)), lambda i: F.element_at(labels, i) != 0)
        # The hits are a prefix of the changed places: all changed ones up to the last hit.
        last = let(lambda hit: F.coalesce(F.get(hit, F.size(hit) - 1), F.lit(0)), let(prefix, changed))
        return let(lambda last: F.transform(labels, lambda l, i: ((l != 0) & (i < last)).cast("int")), last)

    body_mask = let(mask, side_labels(ops, "old"))
    return example(collapse_masks(framed(nl, lang, old),
                                  framed_mask(_nl_mask(nl, seed, key), body_mask)), as_col(new))


def edit_plan_example(nl, lang, old, new, ops) -> Column:
    """Target: new code, a separator, the edit plan."""
    plan = edit_streams(old, new, ops, minimal=True)["spans"]
    return example(framed(nl, lang, old), F.concat(as_col(new), _tag(SEGMENT_TAG), plan))


def change_to_message_example(nl, lang, old, new, limit: int = SIDE_LIMIT) -> Column:
    """Both sides (each up to its length limit) to the message."""
    return example(F.concat(F.array(lang_tag(lang)), F.slice(old, 1, limit), _tag(SEGMENT_TAG),
                            F.slice(new, 1, limit)), F.concat(_tag(MSG_TAG), as_col(nl)))


def plan_to_message_example(nl, old, new, ops) -> Column:
    return example(edit_streams(old, new, ops, minimal=True)["spans"],
                   F.concat(_tag(MSG_TAG), as_col(nl)))


def objective(type_col, seed: str, key) -> Column:
    """The objective of a row: state rows have their own, others are drawn."""
    return (F.when(as_col(type_col) == STATE_TYPE, STATE_TAG)
            .when(draw(seed + "-1", key) < KEEP_SPAN_SHARE, KEEP_SPAN_TAG)
            .when(draw(seed + "-2", key) < CORRUPT_SHARE, CORRUPT_TAG)
            .otherwise(GENERATE_TAG))


def build_examples(df: DataFrame, key: str, seed: str = "mix") -> DataFrame:
    """(key, objective, input, target) from key, type, lang, nl_tokens, old_tokens,
    new_tokens, ops.  Rows without a message count only as states."""
    kept = df.where((F.col("type") == STATE_TYPE) | (F.size("nl_tokens") > 0))
    obj = objective("type", seed, key)
    nl, lang, old, new = "nl_tokens", "lang", "old_tokens", "new_tokens"
    built = kept.withColumn("objective", obj).withColumn("_e", (
        F.when(F.col("objective") == KEEP_SPAN_TAG,
               keep_span_example(nl, lang, old, new, "ops", seed + "-ksm", key))
        .when(F.col("objective") == CORRUPT_TAG,
              corrupted_example(nl, lang, old, new, seed + "-ade", key))
        .when(F.col("objective") == GENERATE_TAG,
              target_example(nl, lang, old, new, seed + "-etg", key))
        .otherwise(state_example(nl, lang, old, new))))
    return built.select(
        key, "objective",
        F.concat(F.array("objective"), F.col("_e.input")).alias("input"),
        F.concat(_tag(UPDATED_TAG), F.col("_e.target")).alias("target"))
