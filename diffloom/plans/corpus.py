"""Corpus preparation: commits to sharded training rows in one lazy chain."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.lex import code_lex, token_length
from ..functions.text import words
from ..operators.filters import (STATE_TYPE, conform, length_gate, real_change, real_change_nonblank,
                                 reject_reason, union_corpora)
from ..operators.hunks import changed_lines, expand_states, extract_hunks
from ..operators.ranking import with_shards
from ..operators.scripts import with_script
from ..session import materialize


def commit_rejects(commits: DataFrame) -> DataFrame:
    """Commits that cannot give hunks, with the reason."""
    reason = reject_reason({
        "missing side": F.col("old_contents").isNull() | F.col("new_contents").isNull(),
        "missing message": F.col("message").isNull(),
        "unchanged": F.col("old_contents") == F.col("new_contents"),
    })
    return commits.withColumn("reason", reason).where(F.col("reason").isNotNull())


def prepared(commits: DataFrame, measure: Callable[[Column], Column] = token_length, seed: str = "42",
             k: int = 30) -> DataFrame:
    """(row_key, repos, msg, old, new, rank, shard): commits to gated, sharded states in one chain."""
    states = state_rows(hunked(commits), measure).where(real_change())
    keyed = states.withColumn("row_key", F.concat_ws("-", "commit", "group_idx", "state_idx"))
    return shard_corpus(keyed, seed, k)


def hunked(commits: DataFrame) -> DataFrame:
    """(commit, repos, msg, hunks) of commits that change a line."""
    return extract_hunks(changed_lines(commits)).select(
        "commit", "repos", F.col("message").alias("msg"), "hunks")


def state_rows(hunks: DataFrame, measure: Callable[[Column], Column] = token_length,
               compat: bool = False) -> DataFrame:
    return length_gate(expand_states(hunks, measure, compat=compat), measure=measure)


def assemble(annotated: DataFrame, commits: DataFrame, states: DataFrame) -> DataFrame:
    """(row_key, proj, nl, old, new, lang, type): the three corpora, real changes only.

    ``row_key`` is unique in each input and becomes unique over all of them.
    """
    names = {"row_key": "row_key", "proj": "repos", "nl": "msg", "old": "old", "new": "new"}
    parts = [
        conform(annotated.where(real_change()), names | {"proj": "proj", "lang": "lang"},
                {"type": "ccn"}),
        conform(commits.where(real_change()), names, {"lang": "java", "type": "commitpack"}),
        conform(states.where(real_change()), names, {"lang": "java", "type": STATE_TYPE}),
    ]
    keyed = [p.withColumn("row_key", F.concat_ws("/", "type", F.col("row_key").cast("string")))
             for p in parts]
    return union_corpora(*keyed)


def shard_corpus(corpus: DataFrame, seed: str = "42", k: int = 30) -> DataFrame:
    """Add ``rank`` and ``shard``: a seeded full shuffle cut into even shards.

    The corpus is written once: its keys are counted and ranked, and its rows joined back.
    """
    return with_shards(materialize(corpus, "corpus"), seed, "row_key", k)


def scripted(corpus: DataFrame, tokens: Callable[[Column], Column] = code_lex) -> DataFrame:
    """Add nl_tokens, old_tokens, new_tokens and the edit script."""
    usable = corpus.where(real_change_nonblank())
    return with_script(
        usable.withColumn("nl_tokens", words("nl"))
        .withColumn("old_tokens", tokens(F.col("old")))
        .withColumn("new_tokens", tokens(F.col("new"))), "old_tokens", "new_tokens")
