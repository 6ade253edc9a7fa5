"""Declared schemas; nothing is inferred from data."""

from pyspark.sql import types as T


def strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


COMMITS = strings("commit", "repos", "message", "old_contents", "new_contents")
GENERATION = strings("nl", "code", "input", "output")
COMMENT_UPDATE = strings("old_comment", "old_code", "new_code", "new_comment")
COMMENT_UPDATE_RAW = strings("old_comment_raw", "old_code_raw", "new_code_raw", "new_comment_raw")
COMMENT_PATCH = strings("diff", "old_nl", "nl")
NL_REFINEMENT = strings("old", "comment", "new")

OPCODE = T.StructType([
    T.StructField("tag", T.StringType()),
    T.StructField("i1", T.IntegerType()),
    T.StructField("i2", T.IntegerType()),
    T.StructField("j1", T.IntegerType()),
    T.StructField("j2", T.IntegerType()),
])
OPCODES = T.ArrayType(OPCODE)
