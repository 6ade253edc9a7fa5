"""The feature cache: entries by key, published whole."""

import os
from concurrent.futures import ThreadPoolExecutor

from diffloom.sources.writers import cached_features, fingerprint


def test_entries_by_key(spark, tmp_path):
    path, built = str(tmp_path), []

    def make(n):
        def build():
            built.append(n)
            return spark.range(n)
        return build

    one, two = fingerprint(split="train", limit=None), fingerprint(split="train", limit=5)
    assert one != two and one == fingerprint(limit=None, split="train")
    schema = spark.range(1).schema
    assert [cached_features(spark, path, make(n), schema, k).count() for n, k in ((7, one), (5, two), (9, one), (9, two))] == [7, 5, 7, 5]
    assert built == [7, 5]
    os.mkdir(tmp_path / "_dead-draft")  # what a builder that died leaves is in nobody's way
    assert cached_features(spark, path, make(9), schema, one).count() == 7


def test_two_builders_of_one_key(spark, tmp_path):
    schema = spark.range(1).schema
    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(lambda n: cached_features(spark, str(tmp_path), lambda: spark.range(n), schema, "k"), [10, 20, 30, 40]))
    counts = {d.count() for d in got}
    assert len(counts) == 1 and counts <= {10, 20, 30, 40} and [p for p in os.listdir(tmp_path) if not p.startswith(".")] == ["k"]
