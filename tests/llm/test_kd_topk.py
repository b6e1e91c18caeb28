import math

import numpy as np
from pyspark.sql import functions as F

from tarnfall.llm import kd_topk


def long(x):
    """The nearest long; the least is one more than a long's."""
    return max(1 - 2**63, min(x, 2**63 - 1))


def plain(rows, is_query, k=20, scale=64):
    fine = [(i, [math.floor(float(x) * scale) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(float(x) * scale) for x in v)]
    out = []
    for q, v in fine:
        if not is_query(q):
            continue
        found = sorted(((-long(sum(a * b for a, b in zip(v, w, strict=True))), i) for i, w in fine if i != q and len(w) == len(v)))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


def rows_of(df):
    return [(r.vec_id, list(r.embedding) if r.embedding is not None else None) for r in df.select("vec_id", "embedding").collect()]


def check(df, **options):
    got = sorted(tuple(r) for r in kd_topk.top_k(df, F.col("vec_id") % 20 == 0, **options).select("query_id", "rank", "vec_id", "score").collect())
    assert got == plain(rows_of(df), lambda i: i % 20 == 0, options.get("k", 20))
    return got


def test_embeddings(spark, sf_dir):
    assert check(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def test_several_shards_and_blocks(spark, sf_dir):
    check(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), shard_rows=60, block=4, blocks_per_task=2)


def test_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=4).tolist(), i) for i in range(90)]
    rows += [(100, None, 0), (120, [1.0, None, 0.0, 0.0], 0), (140, [float("nan"), 0.0, 0.0, 0.0], 0), (160, [float("inf"), 0.0, 0.0, 0.0], 0), (None, [1.0, 1.0, 1.0, 1.0], 0), (180, [0.5, 0.5], 0), (181, [0.25, 1.0], 0), (200, [], 0)]
    rows += [(300 + i, [1.0, 0.0, 0.0, 0.0], 0) for i in range(60)]  # ties beyond k
    rows += [rows[7], rows[7], (7, [9.0, 9.0, 9.0, 9.0], 1)]  # repeated rows, and an id with two vectors
    check(spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int"), shard_rows=50)
    check(spark.createDataFrame(rows[:5], "vec_id long, embedding array<double>, score int"))
    assert check(spark.createDataFrame([], "vec_id long, embedding array<float>, score int")) == []


def test_large_components(spark):
    """Sums beyond 2**52, products beyond a long, and components whose multiple is no longer finite."""
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=3) * 10.0 ** rng.integers(0, 9)).tolist()) for i in range(80)]
    rows += [(100 + i, (rng.normal(size=3) * 10.0 ** rng.integers(5, 18)).tolist()) for i in range(60)]
    rows += [(200, [1e17, 0.0, 0.0]), (201, [1e17, 1e-3, 0.0]), (202, [-1e17, 0.0, 3.0]), (220, [1e300, 1e300, 0.0]), (240, [1e307, 0.0, 0.0]), (260, [2.0**53 + 2, 0.5, 0.25])]
    for some in (rows[:80], rows):
        check(spark.createDataFrame(some, "vec_id long, embedding array<double>"), shard_rows=50)


def test_tree_bounds_hold():
    rng = np.random.default_rng(4)
    x = rng.integers(-50, 50, (1000, 6)).astype(float)
    tree = kd_topk.KdTree(x, leaf=16)
    q = rng.integers(-50, 50, (5, 6)).astype(float)
    bounds = tree.bounds(q)
    for node, (lo, hi) in enumerate(tree.ranges):
        assert (bounds[:, node] >= (q @ tree.vectors[lo:hi].T).max(axis=1)).all()


def test_query_ids_on_several_rows(spark, tmp_path):
    """Each query row has its own results, as the SQL says: an id on two vectors, a row that repeats, very many equal rows."""
    import duckdb

    from tarnfall.llm.oracles import ORACLES
    from tarnfall.llm.registry import op10_kd_topk

    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=4).astype("float32").tolist()) for i in range(1, 60)]
    rows += [(20, rng.normal(size=4).astype("float32").tolist()), rows[39], rows[39], (7, rows[3][1])] + [(61, [0.5, 0.25, 0.0, 1.0])] * 90
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = check(df, shard_rows=30, block=2)
    assert sum(q == 20 for q, *_ in got) == 40 and sum(q == 40 for q, *_ in got) == 60
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted(con.execute(f"SELECT query_id, rank, vec_id, score FROM ({ORACLES['op10_kd_topk']})").fetchall())
    assert sorted(map(tuple, op10_kd_topk(spark, str(tmp_path)).select("query_id", "rank", "vec_id", "score").collect())) == want == got
