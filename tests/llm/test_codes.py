"""Vector codes against plain Python in whole numbers, and against SQL."""

import collections
import hashlib
import math

import duckdb
import numpy as np
import pytest

from hourgrid.llm import codes

FIELDS = "vec_id bigint, embedding array<double>, label int, code string, dims int, n bigint"


def sound(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def plain(rows):
    """(vec_id, code, error, label_error, digest) of (vec_id, vector, label), each length by itself."""
    out, total = [], collections.Counter()
    kept = [r for r in rows if sound(r[1])]
    for dims in {len(r[1]) for r in kept}:
        mine = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in kept if len(v) == dims]
        at = np.cumsum([0, *(len(p) for p in np.array_split(np.arange(dims), 4))]).tolist()
        first = sorted(mine, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:256]
        books = [[r[1][a:b] for r in first] for a, b in zip(at, at[1:])]

        def nearest(v):
            found = [min((sum((x - y) ** 2 for x, y in zip(v[a:b], e)), k) for k, e in enumerate(book)) for a, b, book in zip(at, at[1:], books)]
            return [k for _, k in found], sum(d for d, _ in found)

        for _ in range(4):
            owners = [nearest(v)[0] for _, v, _ in mine]
            for p, (a, b) in enumerate(zip(at, at[1:])):
                for k in range(len(first)):
                    own = [v[a:b] for (_, v, _), o in zip(mine, owners) if o[p] == k]
                    if own:
                        books[p][k] = [sum(c) // len(own) for c in zip(*own)]
        digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
        for i, v, label in mine:
            owner, error = nearest(v)
            out.append((i, "".join(f"{k:02x}" for k in owner), error, label, digest))
            total[label] += error
    return collections.Counter((i, c, e, total[label], d) for i, c, e, label, d in out)


def got(spark, rows):
    df = codes.compress(spark.createDataFrame([(i, v, label, "c", 3, 4) for i, v, label in rows], FIELDS))
    return collections.Counter((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect())


def clustered(seed, n, dims, groups=12, spread=0.02):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(groups, dims)) / 3
    return [(i, (centres[i % groups] + spread * r.normal(size=dims)).tolist(), [1, 2, None][i % 3]) for i in range(n)]


@pytest.mark.parametrize("kind", [np.float64, np.int64])
@pytest.mark.parametrize("shape", ["random", "clusters", "grid", "equal", "tiny"])
def test_trees_and_their_owners(kind, shape):
    """Every row is in the ball of each node above it, and owners, counts and sums are those of a full comparison."""
    r = np.random.default_rng(len(shape))
    part = {
        "random": r.integers(-900, 900, (700, 6)), "clusters": r.integers(-900, 900, (7, 6))[r.integers(0, 7, 900)] + r.integers(-4, 5, (900, 6)),
        "grid": r.integers(0, 3, (600, 3)), "equal": np.full((300, 4), 7), "tiny": r.integers(-9, 9, (1, 4)),
    }[shape]
    tree = codes.tree_of(part.astype(kind))
    assert sorted(tree.order.tolist()) == list(range(len(part)))
    for low, high, left, right, total, middle, radius in zip(tree.low, tree.high, tree.left, tree.right, tree.sums, tree.middle, tree.radius):
        rows = part[tree.order[low:high]]
        assert (rows.sum(axis=0) == total).all() and (np.sqrt(((rows - middle) ** 2).sum(axis=1)) <= radius + 1e-9).all()
        assert left < 0 or (tree.low[left], tree.high[left], tree.low[right], tree.high[right]) == (low, tree.high[left], tree.high[left], high)
    book = np.concatenate([part[:40], part[:3], part[:5] + 1])
    owner, counts, sums = codes.assigned(part.astype(kind), tree, book)
    want = ((part[:, None, :] - book[None, :, :]) ** 2).sum(axis=2).argmin(axis=1)
    assert (owner == want).all() and (counts == np.bincount(want, minlength=len(book))).all()
    assert all((sums[k] == part[want == k].sum(axis=0)).all() for k in range(len(book)))


def test_balls_are_owned_as_a_whole(monkeypatch):
    """On clusters that lie apart no row is compared by itself."""
    r = np.random.default_rng(1)
    centres = r.integers(-900, 900, (9, 8)) * 10
    part = (centres[r.integers(0, 9, 2000)] + r.integers(-3, 4, (2000, 8))).astype(float)
    tree = codes.tree_of(part)
    seen = []
    monkeypatch.setattr(codes.np, "bincount", lambda mine, **k: seen.append(len(mine)))
    _, counts, _ = codes.assigned(part, tree, centres)
    assert not seen and counts.sum() == 2000


@pytest.mark.parametrize("block", [64, 4096])
def test_codes_of_clusters(spark, monkeypatch, block):
    monkeypatch.setattr(codes, "BLOCK", block)
    rows = clustered(2, 500, 16) + [(i, v, 3) for i, v, _ in clustered(2, 30, 16)] + [(600 + i, [0.25] * 16, 4) for i in range(40)]
    rows += [(None, [0.5] * 16, None), (900, None, 1), (901, [None] + [0.1] * 15, 1), (902, [math.nan] * 16, 1), (903, [math.inf] + [0.0] * 15, 2)]
    assert got(spark, rows) == plain(rows)


def test_fewer_vectors_than_entries_and_odd_lengths(spark):
    rows = clustered(3, 20, 6) + [(i + 100, v, 1) for i, v, _ in clustered(4, 9, 3)] + [(200, [], None), (201, [], 1), (202, [1e3, -1e3, 2e4, 0.0, 1.0, -0.0001], 2)]
    assert got(spark, rows) == plain(rows)
    assert got(spark, []) == collections.Counter()


def test_components_too_large_for_exact_distances(spark):
    with pytest.raises(Exception, match="no exact distances"):
        got(spark, [(1, [1e300, 0.0, 0.0, 0.0], 1)])


def test_codes_as_sql(spark):
    with duckdb.connect() as c:
        c.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.001/embeddings.parquet'")
        names = [d[0] for d in c.execute(codes.SQL).description]
        want = collections.Counter(c.execute(codes.SQL).fetchall())
    assert collections.Counter(tuple(r[n] for n in names) for r in codes.op11_vector_codes(spark, "/root/testdata/sf0.001").collect()) == want
