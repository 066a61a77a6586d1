import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanledger.llm.hard_negatives import NEVER, ascending, bit_planes, hard_negatives, scores
from spanledger.llm.queries import ORACLES, QUERIES
from spanledger.llm.vector_codes import nearest, vector_codes
from spanledger.llm.whole_vectors import FURTHEST
from tools.compare import compare, connect

SCHEMA = "vec_id long, embedding array<float>, label int, v string, a int, rank string, codebooks_sha256 string"


def whole(vector):
    if vector is None or any(x is None or not math.isfinite(x) for x in vector):
        return None
    return [max(min(math.floor(256 * float(np.float32(x))), FURTHEST), -FURTHEST) for x in vector]


def odd_rows():
    rnd = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rnd.normal(0, .2, 20).astype(np.float32)], int(rnd.integers(0, 4))) for i in range(130)]
    rows += [(300, None, 1), (301, [], 2), (302, [None] * 20, 1), (303, [float("nan")] * 20, 0), (304, [float("inf")] * 20, 0),
             (305, [1.0] * 20, None), (None, [.5] * 20, 2), (None, [.5] * 20, 2), (306, [9e4] * 20, 3), (307, [.25, -.5], 0),
             (10, rows[10][1], rows[10][2]), (308, rows[7][1], 3), (309, rows[7][1], 3), (310, [0.0] * 20, 1), (400, [-3e38] * 20, 2)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", "z") for r in rows], SCHEMA)


def codes_plain(rows, parts, entries, rounds):
    kept = [(i, whole(v), y) for i, v, y in rows if whole(v) is not None]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // parts) * parts
    size = width // parts
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    kept = [(i, v + [0] * (width - len(v)), y) for i, v, y in kept]
    books = [[(v + [0] * (width - len(v)))[p * size:(p + 1) * size] for _, v, _ in first] for p in range(parts)]

    def assign():
        out = []
        for _, v, _ in kept:
            far = [[sum((a - b) ** 2 for a, b in zip(v[p * size:], e)) for e in books[p]] for p in range(parts)]
            out.append([(min(range(len(f)), key=lambda e: (f[e], e)), min(f)) for f in far])
        return out
    for _ in range(rounds):
        at = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [v[p * size:(p + 1) * size] for (_, v, _), c in zip(kept, at) if c[p][0] == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own)]
    at = assign()
    error = [sum(d for _, d in c) for c in at]
    by_label = {}
    for (_, _, y), e in zip(kept, error):
        by_label[y] = by_label.get(y, 0) + e
    digest = hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{e:02x}" for e, _ in c), err, by_label[y], digest)
                   for (i, _, y), c, err in zip(kept, at, error)), key=repr)


@pytest.mark.parametrize("parts,entries,rounds", [(4, 8, 2), (16, 64, 2), (5, 256, 1), (1, 3, 3)])
def test_codes_of_odd_rows(spark, parts, entries, rounds):
    got = vector_codes(frame(spark, odd_rows()), parts=parts, entries=entries, rounds=rounds).select(
        "vec_id", "code", "error", "label_error", "codebooks_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == codes_plain(odd_rows(), parts, entries, rounds)


def negatives_plain(rows, k=5, n=10):
    own = [(i, whole(v), y) for i, v, y in rows if whole(v) is not None and y is not None]
    order = lambda c: (-c[0], c[1] is None, c[1] or 0)
    out = []
    for i, v, y in own:
        if i is None or i % 10:
            continue
        met = [(sum(a * b for a, b in zip(v, w)), j, z) for j, w, z in own]
        for p, j, _ in sorted((c for c in met if c[2] == y and c[1] != i), key=order)[:k]:
            hard = sorted((c for c in met if c[2] != y and 30 * p <= 100 * c[0] <= 90 * p), key=order)[:n]
            out += [(i, j, r + 1, c[1], p, c[0]) for r, c in enumerate(hard)]
    return sorted(out, key=repr)


def test_negatives_of_odd_rows(spark):
    got = hard_negatives(frame(spark, odd_rows()), F.col("vec_id") % 10 == 0).collect()
    assert sorted(map(tuple, got), key=repr) == negatives_plain(odd_rows())


def test_many_partitions(spark):
    got = hard_negatives(frame(spark, odd_rows()).repartition(23), F.col("vec_id") % 10 == 0).collect()
    assert sorted(map(tuple, got), key=repr) == negatives_plain(odd_rows())


def test_empty_tables(spark):
    none = frame(spark, [])
    assert vector_codes(none).collect() == [] and hard_negatives(none, F.col("vec_id") % 10 == 0).collect() == []
    one = frame(spark, [(10, [.1, .2], 3)])
    assert hard_negatives(one, F.col("vec_id") % 10 == 0).collect() == []
    assert [(r.vec_id, r.code, r.error) for r in vector_codes(one).collect()] == [(10, "00" * 16, 0)]
    assert vector_codes(frame(spark, [(1, [], 0)])).first().error == 0


@pytest.mark.parametrize("most", [3, 200, 40_000, FURTHEST])
def test_scores_are_inner_products(most):
    rnd = np.random.default_rng(most)
    v, a = rnd.integers(-most, most + 1, (3000, 21)), rnd.integers(-most, most + 1, (7, 21))
    v[0], v[1], a[0] = -most, most, -most
    bits, planes = bit_planes(v)
    assert planes.shape == (bits, 3, 3000) and (scores(a, planes) == v @ a.T).all()
    assert (scores(a[:, :10], planes) == v[:, :10] @ a[:, :10].T).all()


@pytest.mark.parametrize("most", [2, 1 << 60])
def test_order_of_equal_scores(most):
    rnd = np.random.default_rng(1)
    score, order, out = rnd.integers(-most, most, (3, 50)), rnd.permutation(50), rnd.random((3, 50)) < .2
    for k in (None, 4, 60):
        s, o = ascending(score, order, out, k)
        for i in range(3):
            want = sorted((int(x), -int(y)) for x, y, z in zip(score[i], order, out[i]) if not z)
            assert [(int(x), -int(y)) for x, y in zip(s[i], o[i]) if x != NEVER] == want[-(k or 50):]


def test_nearest_takes_the_lower_entry():
    values, places = [np.array([0, 4]), np.array([1])], np.array([[0, 1], [0, 0]])
    code, error = nearest(values, places, np.array([[2, 2, 0], [1, 1, 1]]), 1)
    assert code.tolist() == [[2], [0]] and error.tolist() == [[0], [4]]


@pytest.mark.parametrize("name", ["op12_vector_codes", "op13_hard_negatives"])
def test_against_sql(spark, name):
    sf = "/root/testdata/sf0.1"
    assert compare(QUERIES[name](spark, sf).toPandas(), connect(sf).execute(ORACLES[name]).fetchdf()) == "ok"
