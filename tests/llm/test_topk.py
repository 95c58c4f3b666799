import random

import numpy as np

from siltstone.llm import topk
from siltstone.llm.common import ready


def plain(vectors, k, every):
    for q, a in vectors.items():
        if q % every == 0:
            own = sorted(((-sum(x * y for x, y in zip(a, b)), v) for v, b in vectors.items() if v != q))[:k]
            yield from ((q, i + 1, v, -s) for i, (s, v) in enumerate(own))


def test_index_scores():
    rng = np.random.default_rng(1)
    for dims, n, size in ((1, 1, 3), (7, 130, 100), (64, 200, 90), (20, 64, 1 << 20)):
        values = rng.integers(-size, size, (n, dims))
        index = topk.BitSliced.build(np.arange(n), values)
        for q in (rng.integers(-size, size, dims), np.zeros(dims, np.int64), np.full(dims, -size)):
            slices, offset = index.scores(q)
            bits = np.unpackbits(slices.view(np.uint8), axis=1, bitorder="little")[:, :n].astype(object)
            got = [offset + sum(int(b) << i for i, b in enumerate(col)) for col in bits.T]
            assert got == (values @ q).tolist()


def test_same_as_plain(spark):
    ready(spark)
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(12)]) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(40)]  # ties
    rows += [(400, None), (401, [None, 1.0]), (402, [float("nan")]), (403, [float("inf"), 0.0]), (None, [1.0]), (404, []), (450, [0.5] * 3), (500, [1e30])]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, label int, score string")
    f = lambda x: [int(np.floor(256 * float(np.float32(c)))) for c in x]
    vectors = {i: f(x) for i, x in rows if i is not None and x is not None and i not in (401, 402, 403, 500)}
    for block_rows in (64, 8192):
        got = topk.top_k(table, block_rows=block_rows)
        assert sorted(map(tuple, got.collect())) == sorted(plain(vectors, 5, 50))
    assert topk.top_k(table.where("vec_id < 3")).count() == 2
    assert topk.top_k(table.where("false")).count() == 0


def test_every_finite_vector(spark):
    """Components of any size, and rows of equal id, against Python's integers."""
    ready(spark)
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(9)]) for i in range(120)]
    rows += [(200 + i, [rng.gauss(0, 1) * 10.0 ** rng.randrange(2, 307) for _ in range(rng.choice([9, 10]))]) for i in range(60)]
    rows += [(150, [1.0]), (151, [float(1 << 20)]), (152, [5.0]), (153, [float((1 << 54) + 2)]), (154, [-0.0] * 9), (155, [0.0] * 9)]
    rows += [(60, [3.0] * 9), (60, [-3.0] * 9), (61, [9.0] * 9)] + [(62, [8.5] * 9)] * 7 + [(100, [2.0] * 9)] * 2
    exact = [(i, [int(np.floor(256 * c)) if abs(c) < 1 << 53 else 256 * int(c) for c in x]) for i, x in rows]
    want = []
    for q in {i for i, _ in rows if i % 50 == 0 or i == 60}:
        scores = sorted((-sum(x * y for x, y in zip(a, b)), v) for i, a in exact if i == q for v, b in exact if v != q)
        want += [(q, r + 1, v, min(max(-s, -(1 << 63)), (1 << 63) - 1)) for r, (s, v) in enumerate(scores[:5])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for block_rows in (16, 8192):
        got = sorted(map(tuple, topk.top_k(table, block_rows=block_rows, every=10, beyond_long=True).where("query_id % 50 = 0 OR query_id = 60").collect()))
        assert got == sorted(want)


def test_embeddings_with_a_large_component_take_part(spark):
    rows = ready(spark).createDataFrame([(50, [1.0]), (51, [float(1 << 20)]), (52, [5.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, topk.top_k(rows).collect())) == [(50, 1, 51, 1 << 36), (50, 2, 52, 256 * 256 * 5)]
