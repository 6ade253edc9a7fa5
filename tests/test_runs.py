"""N-grams of all orders from one record a place, against counting each order by itself."""

import random
import re

import pyarrow as pa
import pyarrow.compute as pc
import pytest

import __spark_entry__ as entry
from diffloom.operators import runs
from diffloom.operators.grams import document_frequency, gram_counts

SCHEMA = "k int, a array<string>"


def rows(rng, n=120):
    vocab = ["a", "ab", "", "é", "\x01", "b\x00", "zz z", *[f"w{x}" for x in range(12)]]
    made = [(k, [rng.choice(vocab[:rng.choice([1, 2, 19])]) for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 30]))]) for k in range(n)]
    return made + [(3, ["a", "ab"]), (3, ["ab", "a"]), (None, ["a", "b"]), (None, ["a"]), (900, None)]


def want(rows):
    grams = {}
    for k, tokens in rows:
        for n in range(1, 5):
            for i in range(len(tokens or []) - n + 1):
                grams.setdefault((n, "\x1f".join(tokens[i:i + n])), set()).add(k)
    return {g: len(keys) for g, keys in grams.items()}


def test_document_frequency_of_nested_rows(spark):
    data = rows(random.Random(1))
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    nested = gram_counts(df, ["k"], {"r": "a"}, nested=True)
    got = [tuple(r) for r in document_frequency(nested, "r").collect()]
    assert len(got) == len(set(g[:2] for g in got)) and {g[:2]: g[2] for g in got} == want(data)
    assert document_frequency(gram_counts(df.limit(0), ["k"], {"r": "a"}, nested=True), "r").count() == 0
    # A row of different tokens has one record a place and one a token, not one an order.
    one = spark.createDataFrame([(1, [f"t{i}" for i in range(500)])], SCHEMA)
    assert gram_counts(one, ["k"], {"r": "a"}, nested=True).where("n > 0").count() == 500 + 499


@pytest.mark.parametrize("keys, token", [([1], None), ([1], "x\x1fy"), ([1, 1], "x\x1fy")])
def test_nested_rows_refuse_what_they_cannot_tell(spark, keys, token):
    df = spark.createDataFrame([(k, ["a", token]) for k in keys], SCHEMA)
    with pytest.raises(Exception, match="nested n-grams"):
        gram_counts(df, ["k"], {"r": "a"}, nested=True).collect()


@pytest.mark.parametrize("chunk", [1, 7, 1 << 20])
def test_batches_do_not_matter(monkeypatch, chunk):
    for name in ("CHUNK", "TOKENS", "ROWS"):
        monkeypatch.setattr(runs, name, chunk)
    data = [(k, t) for k, (_, t) in enumerate(rows(random.Random(chunk)))]
    batches = [pa.RecordBatch.from_arrays([pa.array([k for k, _ in part]), pa.array([t for _, t in part], pa.list_(pa.string()))], ["k", "a"])
               for part in (data[:50], data[50:])]
    found = [b for b in runs.row_runs(1, "r", 4)(iter(batches))]
    found = [b.filter(pc.greater(b.column("n"), 0)).select(["part", "least", "gram"]) for b in found]
    unpacked = pa.Table.from_batches(list(runs._unpack(runs._pack(iter(found)))))
    order = sorted(range(len(unpacked)), key=lambda i: unpacked.column("gram")[i].as_py().encode())
    ordered = unpacked.take(order).to_batches(max_chunksize=11)
    got = [(r["n"], r["gram"], r["df"]) for b in runs._beginnings(iter(ordered)) for r in b.to_pylist()]
    assert len(got) == len(set(g[:2] for g in got)) and {g[:2]: g[2] for g in got} == want(data)


@pytest.mark.parametrize("name", ["ngram_document_frequency", "ngram_normalizer"])
def test_no_gram_of_each_order_is_shuffled(spark, name):
    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(part" in plan and not re.search(r"hashpartitioning\(n#\d+, gram", plan)
