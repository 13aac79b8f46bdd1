import random

from fieldloom.operators.components import connected_components


def brute(edges):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {x: find(x) for x in up}


def test_random_path_and_star(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(k, k + 1) for k in range(200, 240)] + [(300, 300 + k) for k in range(30)] + [(5, 5), (None, 3), (400, 401), (401, 400)]
    df = spark.createDataFrame(edges, "u long, v long")
    assert {r.node: r.component for r in connected_components(df).collect()} == brute(edges)


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([(1, 1)], "u long, v long")).count() == 0
