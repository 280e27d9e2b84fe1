"""Clusters of prints of known forms."""

from pathlib import Path

import numpy as np
import pytest

from lipimala.llm.shape_clusters import ASPECT, HEIGHT, NEAR, K, Shapes, cluster_descriptions, cluster_members, communities, neighbour_graph, usable_shapes

SCHEMA = "shape_id bigint, grid binary, height double, aspect double, band string, canvas binary, Band2 string"
DATA = "/root/testdata/sf0.1/shape_catalog.parquet"


def _canvas(rows):
    canvas = np.zeros((128, 256), bool)
    canvas[10 : 10 + rows, 20:40] = True
    return bytearray(np.packbits(canvas).tobytes())


def _forms(n, rng):
    """Blocky forms that share less than half of their ink."""
    return [np.kron(rng.random((8, 8)) < 0.5, np.ones((6, 6), bool)) for _ in range(n)]


def _worn(form, rng):
    edge = form ^ np.roll(form, 1, rng.integers(2))
    return form & ~(edge & (rng.random(form.shape) < 0.3))


def _row(i, grid, height=1.0, aspect=1.0, band="main", canvas=None):
    return (i, None if grid is None else bytearray(np.packbits(grid).tobytes()), height, aspect, band, canvas, "x")


def _data(rng):
    forms = _forms(12, rng)
    rows, want = [], {}
    for k, form in enumerate(forms):
        for j in range(1 if k == 0 else 3 + 4 * k):
            i = len(rows)
            rows.append(_row(i, _worn(form, rng), 1 + 0.01 * rng.standard_normal()))
            want.setdefault(k, []).append(i)
    for group, (height, band) in enumerate(((1.6, "main"), (1.0, "above")), 100):  # the same form in another size, another band
        for _ in range(4):
            want.setdefault(group, []).append(len(rows))
            rows.append(_row(len(rows), _worn(forms[3], rng), height, band=band))
    return rows, {(min(g), i) for g in want.values() if len(g) > 1 for i in g}


def test_clusters_are_the_forms(spark):
    rng = np.random.default_rng(5)
    rows, want = _data(rng)
    bad = [_row(900, None), _row(901, np.zeros((48, 48), bool)), _row(902, np.ones((48, 48), bool), None), (903, bytearray(b"xy"), 1.0, 1.0, "main", None, None), (None, rows[0][1], 1.0, 1.0, "main", None, None)]
    catalog = spark.createDataFrame(rows + rows[:5] + bad, SCHEMA)
    assert {tuple(r) for r in cluster_members(catalog).collect()} == want


def test_copies_and_descriptions(spark):
    grid = np.kron(np.random.default_rng(2).random((8, 8)) < 0.5, np.ones((6, 6), bool))
    catalog = spark.createDataFrame([_row(i, grid) for i in range(40)] + [_row(50, grid, band=None), _row(51, grid, band=None)], SCHEMA)
    got = {r.cluster_id: (r.size, len(r.typical)) for r in cluster_descriptions(catalog).collect()}
    assert got == {0: (40, 3), 50: (2, 2)}


def test_empty_catalog(spark):
    assert cluster_members(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_canvas_tells_sizes_apart(spark):
    grid = np.kron(np.random.default_rng(2).random((8, 8)) < 0.5, np.ones((6, 6), bool))
    worn = [_worn(grid, np.random.default_rng(i)) for i in range(7)]
    canvases = [_canvas(60), _canvas(62), _canvas(0), bytearray(b"x"), None, _canvas(30), _canvas(31)]
    rows = [_row(i, w, canvas=c) for i, (w, c) in enumerate(zip(worn, canvases, strict=True))]
    sizes = {r.id: r["size"] for r in usable_shapes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [round(float(np.exp(sizes[i]))) if sizes[i] == sizes[i] else None for i in range(7)] == [60, 62, None, None, None, 30, 31]
    found = {r.cluster_id for r in cluster_members(spark.createDataFrame([rows[i] for i in (0, 1, 5, 6)], SCHEMA)).collect()}
    assert found == {0, 5}


def _nearest(shapes):
    """Distances of the K nearest of every shape among all others, those within NEAR."""
    out = []
    for i in range(len(shapes.ids)):
        j = np.arange(len(shapes.ids))
        j = j[shapes.fits(np.full(len(j), i), j)]
        d = np.sort(shapes.distance(np.full(len(j), i), j))[:K]
        out.append(d[d <= NEAR])
    return out


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")
@pytest.mark.parametrize("block", [8192, 512])
def test_recall_against_all_pairs(spark, block):
    """A neighbour is found where one as near is in the list; forms stay in one block or lie in several."""
    usable = usable_shapes(spark.read.parquet(DATA))
    rows = sorted({(bytes(r.grid), r.band): r for r in usable.collect()}.values(), key=lambda r: r.id)
    usable = spark.createDataFrame(rows, usable.schema)
    column = lambda c: np.array([r[c] for r in rows])
    shapes = Shapes(column("id"), column("band"), column("h"), column("a"), column("size").astype(float), np.frombuffer(b"".join(r.grid for r in rows), np.uint8).reshape(len(rows), -1))
    lists, blocks = neighbour_graph(usable, block=block)
    held = {}
    for r in lists.collect():
        held.setdefault(r.u, []).append(r.d)
    want = found = 0
    for i, d in zip(shapes.ids.tolist(), _nearest(shapes), strict=True):
        want += len(d)
        found += sum(x <= y for x, y in zip(sorted(held.get(i, [])), d, strict=False))
    print("recall", block, found / want)
    assert found / want > 0.9 and max(map(len, held.values())) <= K
    assert blocks.count() == len(rows) and blocks.groupBy("block").count().agg({"count": "max"}).first()[0] <= 2 * block


def test_neighbours_fit(spark):
    rng = np.random.default_rng(9)
    rows, _ = _data(rng)
    usable = usable_shapes(spark.createDataFrame(rows, SCHEMA))
    at = {r.id: r for r in usable.collect()}
    for r in neighbour_graph(usable)[0].collect():
        u, v = at[r.u], at[r.v]
        assert u.band == v.band and abs(u.h - v.h) <= HEIGHT and abs(u.a - v.a) <= ASPECT and 0 <= r.d <= NEAR


def test_one_form_is_one_cluster(spark):
    """Sparse neighbour lists of a single form must not fall into pieces."""
    rng = np.random.default_rng(3)
    form = _forms(1, rng)[0]
    rows = [_row(i, _worn(form, rng)) for i in range(400)]
    assert {tuple(r) for r in cluster_members(spark.createDataFrame(rows, SCHEMA)).collect()} == {(0, i) for i in range(400)}


@pytest.mark.parametrize("block", [8192, 1])
@pytest.mark.parametrize("blocks", [None, [(i, i % 3) for i in range(40)], [(i, 0) for i in range(40)]])
def test_communities_form_within_and_across_blocks(spark, blocks, block):
    edges = [(a + o, b + o, 1.0) for o in (0, 10, 20, 30) for a in range(10) for b in range(10) if a < b and (a + b) % 3] + [(9, 10, 0.05), (29, 30, 0.05)]
    edges = spark.createDataFrame(edges, "u bigint, v bigint, w double")
    got = {r.id: r.community for r in communities(edges, blocks and spark.createDataFrame(blocks, "id bigint, block int"), block=block).collect()}
    assert {k: len({got[i] for i in range(k, k + 10)}) for k in (0, 10, 20, 30)} == {0: 1, 10: 1, 20: 1, 30: 1}
    assert len(set(got.values())) == 4 and communities(edges.limit(0)).count() == 0


def test_communities_of_two_cliques_with_a_weak_bridge(spark):
    edges = [(a + o, b + o, 1.0) for o in (0, 10) for a in range(5) for b in range(5) if a < b] + [(0, 10, 0.05)]
    got = {r.id: r.community for r in communities(spark.createDataFrame(edges, "u bigint, v bigint, w double")).collect()}
    assert len({got[i] for i in range(5)}) == 1 and len({got[i] for i in range(10, 15)}) == 1 and got[0] != got[10]
