"""Neighbours through product-quantised codes."""

import os

import numpy as np
import pytest

from marquee.operators import neighbours, quantized
from marquee.operators.quantized import QuantizedIndex

SHAPE = "id long, embedding array<float>"


def made(rng, n, dim, clusters=0):
    rows = rng.normal(size=(n, dim))
    return rows + 3 * rng.normal(size=(clusters, dim))[rng.integers(0, clusters, n)] if clusters else rows


@pytest.mark.parametrize("dim,clusters", [(32, 0), (10, 0), (32, 12)])
def test_recall_and_exact_similarities(spark, tmp_path, dim, clusters):
    rng = np.random.default_rng(4)
    vectors = made(rng, 1500, dim, clusters)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(9000, [0.0] * dim), (9001, None), (None, vectors[0].tolist())]
    frame = spark.createDataFrame(rows, SHAPE).repartition(3)
    index = QuantizedIndex.build(frame, f"{tmp_path}/index")
    asked = frame.filter("id % 10 = 0")
    found = index.search_many(asked, 10, code_rows=400)
    exact = neighbours.nearest_for_all(frame.filter("id is not null"), 10)
    measured = quantized.recall(found, exact.filter("id % 10 = 0")).first()
    assert measured.queries == 150 and measured.wanted == 1500 and measured.recall >= 0.9
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    got = found.collect()
    assert len(got) == 1500 and all(r.id != r.neighbour and abs(r.similarity - unit[r.id] @ unit[r.neighbour]) < 1e-6 for r in got)
    assert all(r["rank"] == 1 + sum(o.id == r.id and (-o.similarity, o.neighbour) < (-r.similarity, r.neighbour) for o in got) for r in got[:40])
    one = index.search(vectors[70].tolist(), 10, exclude=70).collect()
    assert [r.id for r in one] == [r.neighbour for r in sorted((r for r in got if r.id == 70), key=lambda r: r["rank"])]


def test_codes_are_a_small_part(spark, tmp_path):
    rng = np.random.default_rng(5)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(made(rng, 4000, 64))], SHAPE)
    index = QuantizedIndex.build(frame, f"{tmp_path}/index")

    def stored_bytes(part):
        folder = f"{tmp_path}/index/{part}"
        return sum(os.path.getsize(f"{folder}/{f}") for f in os.listdir(folder) if f.endswith(".parquet"))

    assert stored_bytes("codes") < stored_bytes("vectors") / 4 and index.bytes_read() < 0.25
    assert index.codes.columns == ["id", "code"]  # the scan has no other column


def test_same_codebooks_whatever_the_partitions(spark):
    rng = np.random.default_rng(6)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(made(rng, 300, 8))], SHAPE)
    assert np.array_equal(quantized.train(frame.repartition(2)), quantized.train(frame.repartition(5)))
    assert quantized.train(frame, sample_rows=50).shape == (2, 256, 4)  # fewer rows than centroids


def test_nothing_to_find(spark):
    none = spark.createDataFrame([], SHAPE)
    index = QuantizedIndex.build(none)
    assert index.count == 0 and index.search([1.0, 2.0]).count() == 0 and index.search_many(none).count() == 0
    alone = QuantizedIndex.build(spark.createDataFrame([(1, [1.0, 2.0])], SHAPE))
    assert alone.search([1.0, 2.0], exclude=1).count() == 0 and [r.id for r in alone.search([1.0, 2.0]).collect()] == [1]
    assert alone.search([0.0, 0.0]).count() == 0
