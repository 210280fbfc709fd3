"""Connected components on graphs that are hard for label rounds."""

import random

import pytest
from pyspark.sql import functions as F

from memlake.operators.components import connected_components, contraction
from memlake.plans.shared import SharedStage


def chain(order):
    return list(zip(order, order[1:]))


def orders(n):
    r = random.Random(1)
    mixed = list(range(n))
    r.shuffle(mixed)
    bits = (n - 1).bit_length()
    reverse = sorted(range(n), key=lambda i: int(f"{i:0{bits}b}"[::-1], 2))
    zigzag = [x for i in range(n // 2) for x in (i, n - 1 - i)]
    return {"ascending": list(range(n)), "random": mixed, "zigzag": zigzag, "bit-reversed": reverse}


@pytest.mark.parametrize("kind", ["ascending", "random", "zigzag", "bit-reversed"])
def test_chains_settle_in_few_rounds(spark, kind):
    links = spark.createDataFrame(chain(orders(5000)[kind]), "a long, b long").repartition(4)
    stage = SharedStage(spark, "test")
    maps = contraction(stage.put(links.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")), "links"), stage, in_one_task=100)
    assert 2 < len(maps) < 20
    found = connected_components(links, "a", "b", in_one_task=100)
    assert found.where("component = 0").count() == 5000


def plain(edges):
    root = {}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = find(root.setdefault(a, a)), find(root.setdefault(b, b))
            root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("bound", [0, 10, 10_000])
def test_random_graphs_equal_plain_union_find(spark, bound):
    r = random.Random(bound)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(1000, i) for i in range(1001, 1100)] + [(5000, 5000), (7, 7), (None, 1), (2, None), (None, None)]
    edges += [(b, a) for a, b in edges[:40]] + edges[:40] + chain([9000 + i * 7 % 101 for i in range(101)])
    found = connected_components(spark.createDataFrame(edges, "src long, dst long"), in_one_task=bound).collect()
    assert {x.node: x.component for x in found} == plain(edges) and len(found) == len(plain(edges))


def test_binary_nodes_and_empty_graphs(spark):
    edges = spark.createDataFrame([(b"b", b"a"), (b"c", b"b"), (b"x", b"x")], "src binary, dst binary")
    assert {(bytes(x.node), bytes(x.component)) for x in connected_components(edges).collect()} == {(b"a", b"a"), (b"b", b"a"), (b"c", b"a"), (b"x", b"x")}
    assert connected_components(edges.limit(0)).count() == 0
    assert connected_components(edges.where("src = dst")).count() == 1
