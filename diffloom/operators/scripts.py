"""Edit scripts: native trim and anchored scripts and everything derived from opcodes.

An edit script is ``array<struct<tag,i1,i2,j1,j2>>`` over two token arrays; ranges
are zero-based and half-open, tags are equal / replace / insert / delete.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import as_col, let, once
from ..markers import (DELETE, DELETE_END, INSERT, INSERT_END, KEEP, KEEP_END, REPLACE_END,
                       REPLACE_NEW, REPLACE_OLD)
from ..schemas import OPCODES
from .pairs import edits_by_anchors

STRINGS = "array<string>"
#: Keywords of token and command streams.
COMMANDS = (INSERT, DELETE, REPLACE_OLD, REPLACE_NEW, KEEP)


def span(tokens: Column, start: Column, end: Column) -> Column:
    return F.slice(tokens, start + 1, end - start)


def common_prefix(a: Column, b: Column) -> Column:
    """Number of equal leading elements of two arrays."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    return let(lambda at: F.when(at == 0, F.least(F.size(a), F.size(b))).otherwise(at - 1),
               F.array_position(same, False).cast("int"))


def _op(tag, i1, i2, j1, j2) -> Column:
    return F.struct(F.lit(tag).alias("tag") if isinstance(tag, str) else tag.alias("tag"),
                    i1.cast("int").alias("i1"), i2.cast("int").alias("i2"),
                    j1.cast("int").alias("j1"), j2.cast("int").alias("j2"))


def trim_script(a, b) -> Column:
    """Common prefix, one middle edit, common suffix; empty parts are left out."""

    def build(n, m, p, s):
        zero = F.lit(0)
        tag = (F.when((n - s > p) & (m - s > p), F.lit("replace"))
               .when(n - s > p, F.lit("delete")).otherwise(F.lit("insert")))
        none = F.array().cast(OPCODES)
        return F.concat(
            F.when(p > 0, F.array(_op("equal", zero, p, zero, p))).otherwise(none),
            F.when((n - s > p) | (m - s > p), F.array(_op(tag, p, n - s, p, m - s)))
            .otherwise(none),
            F.when(s > 0, F.array(_op("equal", n - s, n, m - s, m))).otherwise(none))

    def rest(x, p):
        return F.reverse(F.slice(x, p + 1, F.size(x)))

    return let(
        lambda a, b: let(
            lambda p: let(
                lambda s: build(F.size(a), F.size(b), p, s),
                let(common_prefix, rest(a, p), rest(b, p))),
            common_prefix(a, b)),
        a, b)


def anchored_edits(a, b) -> Column:
    """array<struct(i1, i2, j1, j2)>: the parts that differ, in order; one algorithm for all sizes.

    Tokens that occur once on each side and cross no other such token are anchors; between
    neighbouring anchors, what is left after the common prefix and suffix is one edit.
    A Python function of whole columns, so it cannot stand inside a lambda.
    """
    return edits_by_anchors(as_col(a), as_col(b))


def script_of(edits, n, m) -> Column:
    """The whole script of two sides of ``n`` and ``m`` tokens: edits and the kept parts between them."""
    none = F.array().cast(OPCODES)

    def kept(i1, i2, j1, j2):
        return F.when(i1 < i2, F.array(_op("equal", i1, i2, j1, j2))).otherwise(none)

    def build(edits, n, m):
        def one(e, k):
            last = F.get(edits, k - 1)
            tag = (F.when((e["i1"] < e["i2"]) & (e["j1"] < e["j2"]), "replace")
                   .when(e["i1"] < e["i2"], "delete").otherwise("insert"))
            return F.concat(kept(F.coalesce(last["i2"], F.lit(0)), e["i1"], F.coalesce(last["j2"], F.lit(0)), e["j1"]),
                            F.array(_op(tag, e["i1"], e["i2"], e["j1"], e["j2"])))

        last = F.get(edits, F.size(edits) - 1)
        return F.concat(F.flatten(F.transform(edits, one)),
                        kept(F.coalesce(last["i2"], F.lit(0)), n, F.coalesce(last["j2"], F.lit(0)), m))

    return let(build, edits, n, m)


def anchored_script(a, b) -> Column:
    """The anchored edit script of two token arrays."""
    return script_of(anchored_edits(a, b), F.size(a), F.size(b))


def with_script(df: DataFrame, a: str, b: str, out: str = "ops") -> DataFrame:
    """Add the anchored edit script of array columns ``a`` and ``b``."""
    return df.withColumn(out, anchored_script(a, b))


def hunks_of(a, b, edits, context: int = 3) -> Column:
    """array<string>: the edits as hunks of signed lines with up to ``context`` kept lines around.

    Edits at most twice ``context`` lines apart share a hunk.
    """
    def signed(sign, part):
        return F.transform(part, lambda ln: F.concat(F.lit(sign), ln))

    def build(a, b, edits):
        starts = F.filter(F.sequence(F.lit(0), F.size(edits) - 1), lambda k: (k == 0) | (
            F.get(edits, k)["i1"] - F.get(edits, k - 1)["i2"] > 2 * context))

        def hunk(first, end):
            def piece(e, k):
                before = F.when(k == 0, F.greatest(F.lit(0), e["i1"] - context)).otherwise(
                    F.get(edits, first + k - 1)["i2"])
                return F.concat(signed(" ", span(a, before, e["i1"])), signed("-", span(a, e["i1"], e["i2"])),
                                signed("+", span(b, e["j1"], e["j2"])))

            last = F.get(edits, end - 1)["i2"]
            return F.array_join(F.concat(
                F.flatten(F.transform(F.slice(edits, first + 1, end - first), piece)),
                signed(" ", span(a, last, F.least(last + context, F.size(a))))), "\n")

        return let(lambda starts: F.transform(starts, lambda s, g: hunk(
            s, F.coalesce(F.get(starts, g + 1), F.size(edits)))), starts)

    # The edits are bound first, outside of any lambda.
    return let(lambda e, a, b: F.when(F.size(e) == 0, F.array().cast(STRINGS)).otherwise(build(a, b, e)), edits, a, b)


def _labelled(label: str, tokens: Column) -> Column:
    return F.flatten(F.transform(tokens, lambda t: F.array(F.lit(label), t)))


def _streams(a: Column, b: Column, op: Column) -> Column:
    """struct(spans, tokens, commands) of one opcode."""
    old, new = span(a, op["i1"], op["i2"]), span(b, op["j1"], op["j2"])
    n = op["i2"] - op["i1"]

    def pack(spans, tokens, commands):
        return F.struct(spans.alias("spans"), tokens.alias("tokens"), commands.alias("commands"))

    def mark(*tags):
        return F.array(*[F.lit(t) for t in tags])

    return (
        F.when(op["tag"] == "equal", pack(F.concat(mark(KEEP), old, mark(KEEP_END)),
                                          _labelled(KEEP, old), F.array_repeat(F.lit(KEEP), n)))
        .when(op["tag"] == "replace",
              pack(F.concat(mark(REPLACE_OLD), old, mark(REPLACE_NEW), new, mark(REPLACE_END)),
                   F.concat(_labelled(REPLACE_OLD, old), _labelled(REPLACE_NEW, new)),
                   F.concat(F.array_repeat(F.lit(REPLACE_OLD), n), _labelled(REPLACE_NEW, new))))
        .when(op["tag"] == "insert", pack(F.concat(mark(INSERT), new, mark(INSERT_END)),
                                          _labelled(INSERT, new), _labelled(INSERT, new)))
        .otherwise(pack(F.concat(mark(DELETE), old, mark(DELETE_END)),
                        _labelled(DELETE, old), F.array_repeat(F.lit(DELETE), n))))


def edit_streams(a, b, ops, minimal: bool = False) -> Column:
    """struct(spans, tokens, commands): the script as keyword and token streams.

    ``minimal`` leaves the kept parts out: the edit plan.
    """
    kept = as_col(ops)
    if minimal:
        kept = F.filter(kept, lambda op: op["tag"] != "equal")

    def build(a, b, ops):
        # An array of structs reads a field of all its elements.
        return let(
            lambda parts: F.struct(*[F.flatten(parts[f]).alias(f)
                                     for f in ("spans", "tokens", "commands")]),
            F.transform(ops, lambda op: _streams(a, b, op)))

    return let(build, a, b, kept)


def side_labels(ops, side: str) -> Column:
    """Labels aligned to one side's tokens: 0 kept, 1 leaves (old), 2 arrives (new)."""
    lo, hi, mark = ("i1", "i2", 1) if side == "old" else ("j1", "j2", 2)
    return F.flatten(F.transform(as_col(ops), lambda op: F.array_repeat(
        F.when(op["tag"] == "equal", 0).otherwise(mark), op[hi] - op[lo])))


def edit_labels(a, b, ops) -> Column:
    """struct(old_tokens, old_labels, new_tokens, new_labels) read off the script."""

    def build(a, b, ops):
        return F.struct(
            F.flatten(F.transform(ops, lambda op: span(a, op["i1"], op["i2"]))).alias("old_tokens"),
            side_labels(ops, "old").alias("old_labels"),
            F.flatten(F.transform(ops, lambda op: F.when(
                op["tag"] == "equal", span(a, op["i1"], op["i2"])).otherwise(
                span(b, op["j1"], op["j2"])))).alias("new_tokens"),
            side_labels(ops, "new").alias("new_labels"))

    return let(build, a, b, ops)


def payload(b, ops) -> Column:
    """The tokens a script brings in, in order."""
    return let(lambda b, ops: F.flatten(F.transform(
        F.filter(ops, lambda op: op["tag"].isin("insert", "replace")),
        lambda op: span(b, op["j1"], op["j2"]))), b, ops)


def replay(a, incoming, ops) -> Column:
    """struct(tokens, tiles): the new side rebuilt from the old side and incoming tokens.

    Incoming tokens are taken in order, by running sums of the lengths the script's
    target ranges state; ``tiles`` is true when source and target ranges of the script
    follow each other without gaps and use up both inputs.
    """
    def build(a, inc, ops):
        def takes(op):
            return F.when(op["tag"].isin("insert", "replace"), op["j2"] - op["j1"]).otherwise(F.lit(0))

        def piece(op, came):
            return (F.when(op["tag"] == "equal", span(a, op["i1"], op["i2"]))
                    .when(op["tag"] == "delete", F.array().cast(STRINGS))
                    .otherwise(F.slice(inc, came + 1, takes(op))))

        def follows(k):
            op, prev = F.get(ops, k), F.get(ops, k - 1)
            return ((op["i1"] == F.coalesce(prev["i2"], F.lit(0))) & (op["j1"] == F.coalesce(prev["j2"], F.lit(0))))

        last = F.get(ops, F.size(ops) - 1)
        used = F.aggregate(ops, F.lit(0), lambda acc, op: acc + takes(op))
        return F.struct(
            F.flatten(F.zip_with(ops, prefix_sums(F.transform(ops, takes)), piece)).alias("tokens"),
            (F.forall(F.transform(ops, lambda _, k: follows(k)), lambda ok: ok)
             & (F.coalesce(last["i2"], F.lit(0)) == F.size(a)) & (used == F.size(inc))).alias("tiles"))

    return let(build, a, incoming, as_col(ops))


def replay_tokens(stream) -> Column:
    """The new side, read from a token stream alone.

    Every keyword holds for the tokens up to the next one; what comes before the first counts as
    kept.  Kept and arriving tokens are the new side.  A token that looks like a keyword is taken
    for one, so such a text does not come back as it was.  Linear: the stream is cut at its keywords.
    """
    def build(s, marks):
        def part(p, k):
            n = F.coalesce(F.get(marks, k + 1), F.size(s)) - p - 1
            return F.when(F.get(s, p).isin(INSERT, REPLACE_NEW, KEEP), F.slice(s, p + 2, n)).otherwise(F.array().cast(STRINGS))

        return F.concat(F.slice(s, F.lit(1), F.coalesce(F.get(marks, F.lit(0)), F.size(s))), F.flatten(F.transform(marks, part)))

    return let(lambda s: let(lambda marks: build(s, marks), _places(s, lambda t: t.isin(*COMMANDS))), stream)


def replay_commands(a, commands) -> Column:
    """The new side, read from the old side's tokens and a command stream.

    The r-th command that uses up an old token (kept, deleted or replaced) stands for token r;
    kept ones and tokens that are no command are the new side, in the stream's order.  Commands
    beyond the old side's end keep nothing.
    """
    def build(a, s):
        using = _places(s, lambda t: t.isin(KEEP, DELETE, REPLACE_OLD))
        kept = let(lambda u: F.filter(
            F.transform(u, lambda p, r: F.struct(p.alias("at"), F.when(F.get(s, p) == KEEP, F.get(a, r)).alias("t"))),
            lambda x: x["t"].isNotNull()), using)
        own = F.transform(_places(s, lambda t: ~t.isin(*COMMANDS)), lambda p: F.struct(p.alias("at"), F.get(s, p).alias("t")))
        return let(lambda x: x["t"], F.array_sort(F.concat(kept, own)))

    return let(build, a, commands)


def _places(stream: Column, test) -> Column:
    """Zero-based places of the tokens that pass ``test``."""
    marked = F.filter(F.transform(stream, lambda t, i: F.when(test(t), i)), lambda i: i.isNotNull())
    return marked.cast("array<int>")


def prefix_sums(values) -> Column:
    """Sums of all values before each place; blocks of about the square root of the length."""
    def total(x):
        return F.aggregate(x, F.lit(0), lambda acc, v: acc + v)

    def build(values, width):
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / width).cast("int")),
                             lambda g: total(F.slice(values, g * width + 1, width)))

        def before(k, blocks):
            g = F.floor(k / width).cast("int")
            return total(F.slice(blocks, F.lit(1), g)) + total(F.slice(values, g * width + 1, k - g * width))

        return let(lambda blocks: F.transform(values, lambda _, k: before(k, blocks)), blocks)

    return let(lambda v: F.when(F.size(v) == 0, F.array().cast("array<int>")).otherwise(
        let(build, v, F.ceil(F.sqrt(F.size(v))).cast("int"))), values)


def edit_profile(df: DataFrame, ops: str, *slices: str) -> DataFrame:
    """Number of stream keywords per class and corpus slice, from range lengths alone."""
    op = F.col("op")
    old_n, new_n = op["i2"] - op["i1"], op["j2"] - op["j1"]

    def row(keyword, n):
        return F.struct(F.lit(keyword).alias("keyword"), n.cast("long").alias("n"))

    per_op = (F.when(op["tag"] == "equal", F.array(row(KEEP, old_n)))
              .when(op["tag"] == "insert", F.array(row(INSERT, new_n)))
              .when(op["tag"] == "delete", F.array(row(DELETE, old_n)))
              .otherwise(F.array(row(REPLACE_OLD, old_n), row(REPLACE_NEW, new_n))))
    return (df.select(*slices, F.explode(once(ops)).alias("op"))
            .select(*slices, F.inline(per_op))
            .groupBy(*slices, "keyword").agg(F.sum("n").alias("tokens")))


# Predicates on stream keywords -----------------------------------------------

def is_kind(token, kind: str) -> Column:
    """Whether a keyword belongs to insert / keep / replace / delete."""
    return as_col(token).contains(kind.upper())


def is_edit_keyword(token) -> Column:
    t = as_col(token)
    return is_kind(t, "insert") | is_kind(t, "keep") | is_kind(t, "replace") | is_kind(t, "delete")


def is_end(token) -> Column:
    return is_edit_keyword(token) & as_col(token).contains("END")


def is_new(token) -> Column:
    return is_edit_keyword(token) & as_col(token).contains("NEW")


def is_start(token) -> Column:
    return is_edit_keyword(token) & ~as_col(token).contains("NEW") & ~is_end(token)
