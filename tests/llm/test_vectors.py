import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest

from vellum.llm import clustering, points, vector_codes
from vellum.llm.clustering import Centroids, cluster_vectors
from vellum.llm.vector_codes import Codebook, compress_vectors

FLOATS = "vec_id long, embedding array<float>, label int, cluster string, distance int, code int, error string, point string"


def table(spark, vectors, ids=None, labels=None, schema=FLOATS):
    ids = list(range(len(vectors))) if ids is None else ids
    labels = [k % 3 if k % 5 else None for k in range(len(vectors))] if labels is None else labels
    rows = [(i, v, label, "x", 1, 2, "y", "z") for i, v, label in zip(ids, vectors, labels, strict=True)]
    return spark.createDataFrame(rows, schema).repartition(3)


def as_ints(vector, scale, single=True):
    cast = np.float32 if single else float
    return [math.floor(Fraction(float(cast(x))) * scale) for x in vector]


def usable(vector, dimension):
    return vector is not None and len(vector) == dimension and all(x is not None and math.isfinite(x) for x in vector)


def nearest(p, entries):
    return min((sum((a - b) ** 2 for a, b in zip(p, e, strict=True)), k) for k, e in enumerate(entries))


def mean(members):
    return [sum(c) // len(members) for c in zip(*members, strict=True)]


def brute_clusters(rows, dimension, clusters, rounds=3, scale=64):
    kept = [(i, as_ints(v, scale)) for i, v in rows if usable(v, dimension)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest()))
    centroids = [p for _, p in order[:clusters]]
    for _ in range(rounds):
        found = [nearest(p, centroids)[1] for _, p in kept]
        centroids = [mean(own) if (own := [p for (_, p), c in zip(kept, found, strict=True) if c == k]) else old for k, old in enumerate(centroids)]
    final = [(i, *nearest(p, centroids)[::-1]) for i, p in kept]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    sums = [sum(d for _, c, d in final if c == k) for k in range(len(centroids))]
    return sorted(((-1 if i is None else i), c, d, sums[c], sum(sums), digests[c]) for i, c, d in final)


def own_clusters(df):
    return sorted(((-1 if r.vec_id is None else r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


def sample(seed, n, dimension, spread):
    """Vectors on a coarse grid, so that ties and repeated rows are frequent."""
    rng = np.random.default_rng(seed)
    return [[float(x) / spread for x in rng.integers(-3, 4, dimension)] for _ in range(n)]


@pytest.mark.parametrize("spread", [1, 64, 1000])
def test_clusters_equal_brute_force(spark, spread):
    vectors = sample(spread, 150, 8, spread)
    vectors += [vectors[0]] * 60 + [None, [], [1.0] * 7, [None] + [1.0] * 7, [float("nan")] + [0.0] * 7, [float("inf")] * 8, [1e-40] * 8, [-0.0] * 8]
    ids = [*range(len(vectors) - 1), None]
    out = cluster_vectors(table(spark, vectors, ids), dimension=8, clusters=5)
    assert own_clusters(out) == brute_clusters(list(zip(ids, vectors, strict=True)), 8, 5)


def test_large_values(spark):
    """Beyond 64 bits distances are null; assignments, centroids and all smaller distances stay exact."""
    vectors = sample(5, 40, 4, 1) + [[3e38, 0.0, 0.0, 1.0], [-3e38, 1.0, 0.0, 0.0], [1e9] * 4, [1e9, 1e9, 1e9, 1e9 + 128]]
    out = cluster_vectors(table(spark, vectors), dimension=4, clusters=6)
    own = {r.vec_id: r for r in out.collect()}
    expected = brute_clusters(list(enumerate(vectors)), 4, 6)
    assert len(own) == len(expected)
    for i, c, d, total, whole, digest in expected:
        r = own[i]
        assert (r.cluster, r.centroid_sha256) == (c, digest)
        assert (r.distance, r.cluster_inertia, r.inertia) == tuple(x if x < 2**63 else None for x in (d, total, whole))


def test_few_and_no_vectors(spark):
    few = table(spark, [[1.0, 2.0], [3.0, 4.0], None], dict(enumerate([7, 7, 8])).values())
    assert [(r.vec_id, r.distance) for r in cluster_vectors(few, dimension=2).collect()] == [(7, 0), (7, 0)]
    assert {r.code for r in compress_vectors(few, parts=2).collect()} == {"0000", "0101"}
    for none in (few.limit(0), few.filter("embedding is null")):
        assert cluster_vectors(none, dimension=2).collect() == [] and compress_vectors(none, parts=2).collect() == []
        assert cluster_vectors(none, dimension=2).columns[:2] == ["vec_id", "cluster"]
    doubles = table(spark, [[0.1, 1e300], [0.1, 2.0]], schema=FLOATS.replace("array<float>", "array<double>"))
    assert [(r.vec_id, r.error) for r in compress_vectors(doubles, parts=1).collect()] == [(1, 0)]


def test_bounds_skip_and_keep_ties():
    rng = np.random.default_rng(3)
    values = np.floor(np.concatenate([rng.normal(20 * k, 2, (200, 4)) for k in range(8)]))
    rows = values[::200].astype(int).tolist()
    first = Centroids(rows, None, 4)
    cluster, upper, lower, computed = first.first(values)
    moved = [[x + (k % 2) for x in row] for k, row in enumerate(rows)]
    moved[7] = list(moved[6])  # two equal centroids: the lower number wins
    again = Centroids(moved, rows, 4)
    cluster, upper, lower, computed = again.next(values, cluster, upper, clustering.rounded_down(lower).astype(float), computed)
    for v, c, u, low in zip(values.astype(int).tolist(), cluster.tolist(), upper, lower, strict=True):
        d, best = nearest(v, moved)
        assert c == best and u >= math.sqrt(d)
        assert all(low[k] <= math.sqrt(sum((a - b) ** 2 for a, b in zip(v, m, strict=True))) * (1 + 1e-12) for k, m in enumerate(moved))
    assert computed.mean() < 8 + 4  # eight at first; then mostly none


def brute_codes(rows, parts, count, rounds=2, scale=256):
    kept = [(i, label, as_ints(v, scale)) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][2]) // parts
    cut = lambda p, k: p[k * width : (k + 1) * width]
    books = [[cut(p, k) for _, _, p in sorted(kept, key=lambda r: (r[0] is None, r[0]))[:count]] for k in range(parts)]
    for _ in range(rounds):
        for k, book in enumerate(books):
            found = [nearest(cut(p, k), book)[1] for _, _, p in kept]
            books[k] = [mean(own) if (own := [cut(p, k) for (_, _, p), c in zip(kept, found, strict=True) if c == e]) else old for e, old in enumerate(book)]
    out = []
    for i, label, p in kept:
        best = [nearest(cut(p, k), book) for k, book in enumerate(books)]
        out.append((-1 if i is None else i, label, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best)))
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    sums = {}
    for _, label, _, error in out:
        sums[label] = sums.get(label, 0) + error
    return sorted((i, code, error, sums[label], digest) for i, label, code, error in out)


@pytest.mark.parametrize(("spread", "count"), [(1, 64), (256, 64), (1000, 40)])
def test_codes_equal_brute_force(spark, spread, count):
    vectors = sample(spread, 200, 12, spread)
    vectors += [vectors[0]] * 90 + [None, [None] + [1.0] * 11, [float("nan")] * 12, [float("-inf")] * 12, [1e-40] * 12]
    labels = [None if k % 7 == 0 else 1 if k % 2 else k % 4 for k in range(len(vectors))]
    ids = [*range(len(vectors) - 1), None]
    out = compress_vectors(table(spark, vectors, ids, labels), parts=4, count=count)
    own = sorted((-1 if r.vec_id is None else r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in out.collect())
    assert own == brute_codes(list(zip(ids, vectors, labels, strict=True)), 4, count)


def test_other_lengths_are_dropped(spark):
    mixed = table(spark, [[1.0] * 4, [2.0] * 8, [3.0] * 4, [1.0] * 5])
    assert {r.vec_id for r in compress_vectors(mixed, parts=2).collect()} == {0, 2}
    assert {r.vec_id for r in compress_vectors(mixed, parts=2, dimension=8).collect()} == {1}


def test_large_codes(spark):
    vectors = sample(9, 70, 4, 1) + [[3e38, 0.0, 1.0, 1.0], [-3e38, 1.0, 5e8, 0.0]]
    labels = [k % 2 for k in range(len(vectors))]
    own = {r.vec_id: r for r in compress_vectors(table(spark, vectors, labels=labels), parts=2).collect()}
    for i, code, error, total, digest in brute_codes(list(zip(range(len(vectors)), vectors, labels, strict=True)), 2, 64):
        assert (own[i].code, own[i].codebooks_sha256) == (code, digest)
        assert (own[i].error, own[i].label_error) == tuple(x if x < 2**63 else None for x in (error, total))


@pytest.mark.parametrize("spread", [3, 40, 100_000, 2**28])
def test_tree_finds_the_nearest(spread):
    rng = np.random.default_rng(spread)
    book = rng.integers(-spread, spread, (64, 4)).tolist()
    book[10] = list(book[50])
    asked = np.concatenate([rng.integers(-spread, spread, (500, 4)), np.array(book)]).astype(float)
    tree = Codebook(book, 4)
    index, best, compared = tree.search(asked)
    assert [(d, i) for d, i in zip(best.tolist(), index.tolist(), strict=True)] == [nearest([int(x) for x in p], book) for p in asked]
    if spread >= 40:
        assert compared < 0.75 * 64 * len(asked)  # branches are left out


def test_limbs():
    for v in (0, -1, 5, -(2**139), 2**139, 2**80, -(2**40)):
        assert sum(x << (points.LIMB * i) for i, x in enumerate(points.limbs(v))) == v
        assert all(-(2**63) <= x < 2**63 for x in points.limbs(v))
    assert points.as_long(2**63) is None and vector_codes.ENTRIES == 64
