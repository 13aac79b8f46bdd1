import hashlib
import math
import random

import pytest

from fieldloom.llm import clustering as C


def brute(rows, k, rounds, size):
    kept = [(i, [math.floor(64 * float(v)) for v in x]) for i, x in rows if x is not None and len(x) == size and all(v is not None and math.isfinite(v) for v in x)]
    name = lambda i: hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    centres = [x for _, x in sorted(((name(i), x) for i, x in kept))[:k]]
    distance = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    assign = lambda: [min((distance(x, c), n) for n, c in enumerate(centres)) for _, x in kept]
    for _ in range(rounds):
        own = assign()
        for n in range(len(centres)):
            if members := [x for (_, x), (_, c) in zip(kept, own, strict=True) if c == n]:
                centres[n] = [sum(column) // len(members) for column in zip(*members, strict=True)]
    own = assign()
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    within = lambda n: sum(d for d, c in own if c == n)
    return sorted(((i is not None, i or 0), c, d, within(c), sum(d for d, _ in own), digest[c]) for (i, _), (d, c) in zip(kept, own, strict=True))


def rows_of(got):
    return sorted(((r.vec_id is not None, r.vec_id or 0), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got.collect())


KIND = "vec_id long, embedding array<float>"


@pytest.mark.parametrize("k,rounds", [(5, 3), (1, 2), (40, 4)])
def test_equals_brute_force(spark, k, rounds):
    rng = random.Random(k)
    rows = [(n, [rng.choice((-0.5, 0.25, 0.3, 0.0)) + 0.01 * rng.randint(-3, 3) for _ in range(4)]) for n in range(90)]
    rows += [(n, rows[3][1]) for n in range(200, 240)]  # one very common vector
    rows += [(3, rows[3][1]), (3, rows[4][1]), (None, rows[5][1]), (300, None), (301, []), (302, [1.0] * 3), (303, [1.0, None, 2.0, 3.0]), (304, [1.0, math.nan, 2.0, 3.0]), (305, [math.inf] * 4), (306, [1.0] * 5)]
    df = spark.createDataFrame([(i, None if x is None else [None if v is None else float(v) for v in x]) for i, x in rows], KIND).selectExpr("*", "'a' as owner", "1 as id", "2 as x").repartition(3)
    exact = [(r.vec_id, r.embedding) for r in df.collect()]  # components as the floats that they become
    assert rows_of(C.lloyd(df, k=k, rounds=rounds, size=4)) == brute(exact, k, rounds, 4)


def test_few_vectors_and_none(spark):
    got = C.lloyd(spark.createDataFrame([(1, [0.1, 0.2]), (2, [0.3, 0.1])], KIND), size=2)
    assert sorted((r.vec_id, r.distance) for r in got.collect()) == [(1, 0), (2, 0)]
    empty = C.lloyd(spark.createDataFrame([(1, None)], KIND))
    assert empty.collect() == [] and empty.columns == got.columns


def test_a_component_without_an_exact_distance_raises(spark):
    with pytest.raises(Exception, match="no exact distance"):
        C.lloyd(spark.createDataFrame([(1, [3.0e7] * 2)], KIND), size=2).collect()


def test_an_assignment_compares_with_what_has_moved_only(spark):
    """With no centroid moved nothing is compared: the owners stay, whatever the centroids say."""
    import numpy as np

    state = spark.createDataFrame([(1, [5, 5], 0, 50), (2, [9, 9], 1, 2)], "id long, x array<int>, owner int, distance long")
    got = C._assigned(state, np.array([[9, 9], [5, 5]]), [])
    assert sorted((r.id, r.owner, r.distance) for r in got.collect()) == [(1, 0, 50), (2, 1, 2)]
    got = C._assigned(state, np.array([[9, 9], [5, 5]]), [1])
    assert sorted((r.id, r.owner, r.distance) for r in got.collect()) == [(1, 1, 0), (2, 0, 0)]
