"""Geometry, text and graph kernels against hand-computed values."""

import itertools
import math
import random

import duckdb
import pytest

from fiberloom.functions import kernel
from fiberloom.operators import network, tables

SQUARE = [(0, 0), (10, 0), (10, 10), (0, 10)]


def test_ring_area_and_clip():
    assert kernel.area(SQUARE) == 100
    assert kernel.area(kernel.clip_convex(SQUARE, [(5, 5), (15, 5), (15, 15), (5, 15)])) == pytest.approx(25)
    assert kernel.clip_convex(SQUARE, [(20, 20), (30, 20), (30, 30)]) == []
    assert kernel.area(kernel.clip_convex(SQUARE, [(2, 2), (2, 4), (4, 4), (4, 2)])) == pytest.approx(4)  # clockwise


def test_contains_edges():
    assert kernel.contains(SQUARE, 5, 5) and kernel.contains(SQUARE, 0, 3) and not kernel.contains(SQUARE, 11, 5)


def test_crossing():
    assert kernel.crossing((0, 0), (10, 10), (0, 10), (10, 0)) == pytest.approx((5, 5))
    assert kernel.crossing((0, 0), (1, 0), (2, 0), (3, 0)) is None
    assert kernel.crossing((0, 0), (4, 0), (2, 0), (6, 0)) == pytest.approx((3, 0))


def test_linear_referencing():
    line = [(0, 0), (10, 0), (10, 10)]
    assert kernel.length(line) == 20
    assert kernel.measure(line, 12, 5) == pytest.approx((15, 2))
    assert kernel.substring(line, 5, 15) == [(5, 0), (10, 0), (10, 5)]
    (a, b), = kernel.near_spans([(0, 0), (100, 0)], [(30, 5), (60, 5)], 5.0001)
    assert (a, b) == pytest.approx((30, 60), abs=0.1)


def test_merge_lines():
    out = kernel.merge_lines([[(0, 0), (1, 0)], [(2, 0), (1, 0)], [(2, 0), (3, 0)], [(9, 9), (8, 8)]])
    assert sorted(map(kernel.length, out)) == pytest.approx([math.sqrt(2), 3])
    fork = kernel.merge_lines([[(0, 0), (1, 0)], [(1, 0), (2, 0)], [(1, 0), (1, 1)]])
    assert len(fork) == 3


def test_jaro_winkler_equals_duckdb():
    rng = random.Random(1)
    words = ["", "martha", "marhta", "dixon", "dicksonx", "site_id"] + ["".join(rng.choice("abcd") for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    c = duckdb.connect()
    assert kernel.jaro_winkler("", "") == 1.0
    for a, b in itertools.product(words[1:], words[1:]):
        assert kernel.jaro_winkler(a, b) == pytest.approx(c.execute("select jaro_winkler_similarity(?, ?)", [a, b]).fetchone()[0], abs=1e-12), (a, b)


def test_shortest_path():
    g = network.adjacency([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 5.0), (3, 4, 1.0), (8, 9, 1.0)])
    assert network.path(g, 1, 4) == [1, 2, 3, 4]
    assert network.path(g, 1, 9) is None
    assert network.dijkstra(g, [1], cutoff=2)[0] == {1: 0.0, 2: 1.0, 3: 2.0}


@pytest.mark.parametrize("end", [None, 1])
def test_tours_are_best(end):
    rng = random.Random(2)
    p = [(rng.random(), rng.random()) for _ in range(7)]
    d = [[math.dist(a, b) for b in p] for a in p]
    nodes = [i for i in range(1, 7) if i != end]
    cost, order = network.tour(d, 0, end, nodes)
    last = 0 if end is None else end
    best = min(sum(d[a][b] for a, b in zip((0, *q), (*q, last), strict=True)) for q in itertools.permutations(nodes))
    assert cost == pytest.approx(best) and sorted(order) == nodes
    rough, order = network.tour(d, 0, end, nodes, exact=0)
    assert sorted(order) == nodes and rough >= best - 1e-9


def test_linkage_keeps_diameter():
    x = [0, 1, 2, 10, 11, 30]
    d = [[abs(a - b) for b in x] for a in x]
    labels = network.complete_linkage(d, limit=5)
    assert labels == [0, 0, 0, 3, 3, 5]
    assert len(set(network.resplit(d, [0] * 6, 2))) >= 3


def test_insert_limit_is_exact():
    out = network.insert_members(["h", "a", "b"], {"n1": "a", "n2": "a", "n3": "b"}, {"n1": 2, "n2": 1, "n3": 3}, 4, lambda ids: len(ids) - 1)
    assert out == ["h", "a", "n2", "n1", "b"]


def test_header_names():
    assert tables.clean_names(["A\nb*", "x.1", "x", "y"]) == ["Ab", "x_1", "x_2", "y"]
    assert tables.clean_names(["Site Name"], lowercase=True) == ["site_name"]
