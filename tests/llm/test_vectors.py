"""The vector range join against all pairs."""

import numpy as np
import pytest

from plain import reachable, write
from rinseframe.llm import queries, vectors

SCHEMA = "vec_id long, embedding array<float>, label int"


def by_all_pairs(rows, cosine=0.95):
    good = {i: np.array(v, dtype=np.float64) for i, v in rows if v is not None and len(v) and None not in v}
    good = {i: v for i, v in good.items() if np.isfinite(v).all() and v.any()}
    links = []
    for a, x in good.items():
        for b, y in good.items():
            if a < b and len(x) == len(y) and x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= cosine:
                links.append((a, b))
    root = reachable([i for i, _ in rows], links)
    return {i: (sum(i in link for link in links), root[i]) for i, _ in rows}


def check(frame, rows):
    found = frame.collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in found} == by_all_pairs(rows) and len(found) == len(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in found)


def test_all_vectors(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check(queries.op10_metric_range_join(spark, sf), rows)


@pytest.mark.parametrize("points,block", [(8, 4), (30, 1000), (100_000, 7)])
def test_cells_and_blocks(spark, tmp_path, monkeypatch, points, block):
    monkeypatch.setattr(vectors, "CELL_POINTS", points)
    monkeypatch.setattr(vectors, "BLOCK_ROWS", block)
    rng = np.random.default_rng(points)
    centers = rng.normal(size=(12, 6))
    rows = []
    for i in range(240):
        v = (centers[i % 12] + rng.normal(size=6) * 0.25).astype(np.float32)
        if i % 10 == 0:
            v = centers[0].astype(np.float32)
        rows.append((i, (v * rng.choice([1, 3, 0.001])).tolist()))
    rows += [(500, None), (501, []), (502, [0.0] * 6), (503, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (504, [float("nan")] * 6)]
    rows += [(505, [float("inf")] * 6), (506, [1.0, 2.0]), (507, [2.0, 4.0]), (508, [-1.0, -2.0]), (509, [1e-40] * 6), (510, [3e38] * 6)]
    write(spark, [(i, v, 0) for i, v in rows], tmp_path, SCHEMA, "embeddings")
    check(queries.op10_metric_range_join(spark, str(tmp_path)), rows)


def test_odd_rows(spark):
    rows = [(None, [1.0, 0.0], 1), (3, [1.0, 0.0], 1), (3, [1.0, 0.0], 2), (2, [1.0, -0.0], 3), (9, [0.0, 1.0], 4)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, N_Links int")
    found = vectors.similar_groups(frame)
    assert found.columns == ["vec_id", "embedding", "n_links", "component_id", "kept"]
    rows = sorted((r.vec_id or -1, r.n_links, r.component_id or -1, r.kept) for r in found.collect())
    assert rows == [(-1, 0, -1, True), (2, 2, 2, True), (3, 2, 2, False), (3, 2, 2, False), (9, 0, 9, True)]
    assert vectors.similar_groups(frame.limit(0)).collect() == []


def test_forest_keeps_what_is_connected():
    rng = np.random.default_rng(2)
    linked = rng.random((300, 280)) < 0.004
    a, b = np.arange(300), np.arange(1000, 1280)
    nodes, labels = vectors.forest(linked, a, b)
    expected = reachable([*a, *b], [(a[i], b[j]) for i, j in zip(*np.nonzero(linked))])
    assert {n: l for n, l in zip(nodes, labels)} == {n: r for n, r in expected.items() if n != r}
