import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodespark.llm import bpe, packing
from lodespark.storage import stored


def test_hilbert_neighbours_are_one_step_apart():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        n = 1 << bits
        grid = np.stack(np.meshgrid(*[np.arange(n)] * dims, indexing="ij"), -1).reshape(-1, dims)
        key = packing.hilbert_key(grid, bits)
        assert sorted(key) == list(range(n**dims))
        walk = grid[np.argsort(key)]
        assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def packed(spark, sizes, capacities, **kw):
    rnd = random.Random(4)
    df = spark.createDataFrame([(i, n, rnd.randrange(1 << 20)) for i, n in enumerate(sizes)], "id long, n_tokens long, place long")
    return packing.fill(stored(df, "sized"), capacities, **kw).collect()


def check(sizes, capacities, got):
    for spec, cap in capacities.items():
        parts, load = {}, {}
        for r in got:
            if r.spec_id == spec:
                parts.setdefault(r.id, []).append((r.piece_start, r.n_tokens))
                if r.container_id is not None:
                    load[r.container_id] = load.get(r.container_id, 0) + r.n_tokens
        assert set(parts) == set(range(len(sizes)))
        for i, n in enumerate(sizes):
            at = 0
            for start, k in sorted(parts[i]):
                assert start == at and k <= cap
                at += k
            assert at == n and (n > cap or len(parts[i]) == 1)
        assert all(0 < v <= cap for v in load.values())
        yield sum(sizes) / (len(load) * cap)


def test_every_document_is_packed_and_little_room_is_left(spark):
    rnd = random.Random(1)
    sizes = [0] * 40 + [int(rnd.lognormvariate(5, 1.2)) + 1 for _ in range(6_000)] + [100_000, 512, 513, 1024]
    capacities = {1: 512, 3: 4096}
    got = packed(spark, sizes, capacities)
    assert all(full > 0.99 for full in check(sizes, capacities, got))


def test_ranges_and_one_place_for_all(spark):
    sizes = [7] * 500 + [300] * 30
    df = spark.createDataFrame([(i, n, 5) for i, n in enumerate(sizes)], "id long, n_tokens long, place long")
    got = packing.fill(stored(df, "sized"), {1: 512}, range_rows=100).collect()
    assert list(check(sizes, {1: 512}, got))
    assert len({r.container_id >> 36 for r in got}) > 2


def test_empty_table_and_empty_texts(spark):
    df = spark.createDataFrame([], "id long, n_tokens long, place long")
    assert packing.fill(stored(df, "sized"), {1: 10}).count() == 0
    got = packed(spark, [0, 0], {1: 10, 2: None, 3: 0})
    assert [(r.spec_id, r.container_id, r.n_tokens) for r in got] == [(1, None, 0)] * 2


@pytest.mark.skipif(not os.path.exists(bpe.default_path()), reason="no vocabulary files")
def test_documents(spark):
    docs = spark.createDataFrame([(1, "the report " * 50, 1), (2, None, 1), (3, "", 1), (4, "the report " * 50, 1)], "doc_id long, text string, n_tokens int")
    specs = spark.createDataFrame([(1, 64), (None, 64), (2, None)], "spec_id int, capacity_tokens int")
    got = packing.pack_documents(docs, specs).collect()
    n = len(bpe.encoder(bpe.default_path()).encode("the report " * 50))
    assert sum(r.n_tokens for r in got if r.doc_id == 1) == n and {r.doc_id for r in got} == {1, 2, 3, 4}
    where = packing.project([bpe.encoder(bpe.default_path()).encode(t) for t in ("the report", "the report", "")])
    assert (where[0] == where[1]).all() and not where[2].any()


SF = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.exists(bpe.default_path()) or not os.path.isdir(SF), reason="no vocabulary files or no tables")
def test_containers_hold_neighbours_and_are_full(spark):
    places = stored(packing.placed(stored(packing.measured(spark.read.parquet(f"{SF}/documents.parquet")), "measured")), "places")
    at = {r.id: i for i, r in enumerate(places.orderBy("place", F.xxhash64("id")).collect())}
    tokens = places.agg(F.sum("n_tokens")).collect()[0][0]
    capacities = {1: 512, 2: 2048, 3: 4096}
    ends = {}
    for r in packing.fill(places, capacities).collect():
        if r.container_id is not None and r.n_tokens:
            ends.setdefault((r.spec_id, r.container_id), []).append(at[r.id])
    for spec, cap in capacities.items():
        spans = [max(v) - min(v) for (s, _), v in ends.items() if s == spec]
        assert sum(spans) / len(spans) < 0.02 * len(at)
        assert tokens / (cap * len(spans)) > 0.98


def test_more_specs_than_one_pass_takes(spark, monkeypatch):
    monkeypatch.setattr(packing, "SPECS", 2)
    docs = spark.createDataFrame([(1, "the report"), (2, "a note")], "doc_id long, text string")
    specs = spark.createDataFrame([(i, 10 + i) for i in range(5)] * 2, "spec_id int, capacity_tokens int")
    assert sorted((r.spec_id, r.doc_id) for r in packing.pack_documents(docs, specs).collect()) == [(s, d) for s in range(5) for d in (1, 2)]
    assert packing.pack_documents(docs, specs.limit(0)).count() == 0
