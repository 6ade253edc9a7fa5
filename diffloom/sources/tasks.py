"""Task readers: every dataset becomes (idx, source, target, old_comm)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schemas
from ..functions.patch import split_patch_after_blank
from ..functions.text import collapse, strip
from .readers import numbered_jsonl, read_json_records, read_paired_lines

# File names per split; any other split name reads the validation files.
SPLITS = {"train": "train", "test": "test"}
SEGMENT = " <s> "


def _examples(df: DataFrame, source, target, old_comm=None) -> DataFrame:
    old = F.lit("") if old_comm is None else old_comm
    return df.select("idx", source.alias("source"), target.alias("target"), old.alias("old_comm"))


def flat(c):
    """Line ends to spaces, then trimmed."""
    return strip(F.replace(F.col(c) if isinstance(c, str) else c, F.lit("\n"), F.lit(" ")))


def shape_generation(df: DataFrame) -> DataFrame:
    """Code generation; records carry either nl/code or input/output."""
    has_nl = F.col("nl").isNotNull()
    return _examples(df, strip(F.when(has_nl, F.col("nl")).otherwise(F.col("input"))),
                     strip(F.when(has_nl, F.col("code")).otherwise(F.col("output"))))


def shape_pairs(df: DataFrame, raw: bool = False) -> DataFrame:
    """Paired lines, whitespace collapsed unless ``raw`` keeps them as they are."""
    if raw:
        return _examples(df, F.col("source"), F.col("target"))
    return _examples(df, collapse("source"), collapse("target"))


def shape_comment_update(df: DataFrame, suffix: str = "") -> DataFrame:
    """Comment, old code and new code as one source; only the new code is made one line."""
    def c(name):
        return F.col(name + suffix)

    source = F.concat_ws(SEGMENT, strip(c("old_comment")), strip(c("old_code")),
                         F.replace(strip(c("new_code")), F.lit("\n"), F.lit(" ")))
    return _examples(df, source, flat(c("new_comment")), flat(c("old_comment")))


def shape_comment_patch(df: DataFrame) -> DataFrame:
    """Comment update from a patch: the two sides come out of its text."""
    staged = df.withColumn("_p", split_patch_after_blank("diff"))
    source = F.concat_ws(SEGMENT, strip("old_nl"), strip(F.col("_p.old")),
                         F.replace(strip(F.col("_p.new")), F.lit("\n"), F.lit(" ")))
    return _examples(staged.where(F.col("_p").isNotNull()), source, flat("nl"), flat("old_nl"))


def shape_nl_refinement(df: DataFrame) -> DataFrame:
    return _examples(df, F.concat(F.col("old"), F.lit(SEGMENT), F.col("comment")), F.col("new"))


def _split(name: str, other: str = "valid") -> str:
    return SPLITS.get(name, other)


def _number_records(df: DataFrame) -> DataFrame:
    """Records of one array file, numbered in file order (such a file is one task anyway)."""
    return df.withColumn("idx", F.monotonically_increasing_id())


def _pairs(spark, root, split, of, src_ext, tgt_ext, stem, raw=False):
    base = f"{root}/{_split(split)}.{stem}"

    def side(line):
        shaped = line if raw else collapse(line)
        return shaped if of is None else of(shaped)

    # Lines are shaped where they are read, before the sides meet.
    return shape_pairs(read_paired_lines(spark, f"{base}.{src_ext}", f"{base}.{tgt_ext}", side), raw=True)


def _translation(src_ext, tgt_ext):
    return lambda spark, root, split, of=None: _pairs(spark, root, split, of, src_ext, tgt_ext, "java-cs.txt")


def _of_rows(reader):
    """A reader of one file: ``of`` is taken of its rows."""
    def read(spark, root, split, of=None):
        rows = reader(spark, root, split)
        return rows if of is None else rows.withColumns({c: of(F.col(c)) for c in ("source", "target")})

    return read


READERS = {
    "generation": _of_rows(lambda spark, root, split: shape_generation(numbered_jsonl(
        spark, f"{root}/{_split(split, 'dev')}_o.json", schemas.GENERATION))),
    "java-to-csharp": _translation("java", "cs"),
    "csharp-to-java": _translation("cs", "java"),
    "bugfix": lambda spark, root, split, of=None: _pairs(
        spark, root, split, of, "buggy", "fixed", root.rstrip("/").rsplit("/", 1)[-1]),
    "refinement": lambda spark, root, split, of=None: _pairs(
        spark, root, split, of, "buggy", "fixed", "buggy-fixed", raw=True),
    "review": lambda spark, root, split, of=None: _pairs(spark, root, split, of, "buggy", "fixed", "code-review"),
    "comment-update": _of_rows(lambda spark, root, split: shape_comment_update(_number_records(
        read_json_records(spark, f"{root}/{_split(split)}.json", schemas.COMMENT_UPDATE)))),
    "comment-update-raw": _of_rows(lambda spark, root, split: shape_comment_update(_number_records(
        read_json_records(spark, f"{root}/{_split(split)}.json", schemas.COMMENT_UPDATE_RAW)),
        "_raw")),
    "comment-patch": _of_rows(lambda spark, root, split: shape_comment_patch(numbered_jsonl(
        spark, root, schemas.COMMENT_PATCH))),
    "nl-refinement": _of_rows(lambda spark, root, split: shape_nl_refinement(numbered_jsonl(
        spark, f"{root}/{_split(split)}.json", schemas.NL_REFINEMENT))),
}


def load_task(spark: SparkSession, task: str, root: str, split: str, of=None) -> DataFrame:
    """Examples of a named task; the name, not the path, picks the reader.

    ``of`` is taken of source and target, of paired lines before the two files meet.
    """
    examples = READERS[task](spark, root, split, of)
    return examples.select(F.lit(task).alias("task"), F.lit(split).alias("split"), "*")
