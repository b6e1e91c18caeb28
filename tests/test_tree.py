"""The listing of a folder: what is found, and what is planned as a partition."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from tarnfall.sources import files, tree


def made(folder, contents):
    for rel, data in contents.items():
        at = folder / rel
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(data)
    return folder


TREE = {
    "a.ts": b"x", ".env": b"K=1", "_b.TSX": b"", "src/c.Js": b"1\r\n2", "src/deep/er/d.py": b"\xff\xfe ok", "src/deep/.hidden/e.ts": b"e", "node_modules/p/f.ts": b"no", ".git/config": b"no",
    "dist/g.js": b"built", "dist/node_modules/h.js": b"no", "src/no extension": b"n", "src/dots.min.js": b"m", "sp ace/ä ö.ts": b"u", "big.js": b"b" * 5000,
}


def expected(contents):
    return sorted(r for r in contents if not {*r.split("/")[:-1]} & {"node_modules", ".git"})


def test_files_and_extensions(spark, tmp_path):
    root = made(tmp_path / "t", TREE)
    (root / "empty").mkdir()
    for at in (str(root), f"{root}/", root.as_uri()):
        for spread in (1, 3, 100):
            rows = tree.manifest(spark, at, spread=spread).collect()
            assert sorted(r.rel for r in rows) == expected(TREE)
    by = {r.rel: r for r in rows}
    assert by["_b.TSX"].ext == "tsx" and by[".env"].ext == "" and by["src/dots.min.js"].ext == "js" and by["src/no extension"].ext == "" and by["big.js"].size == 5000
    read = {r.rel: r.content for r in files.read_contents(tree.manifest(spark, str(root))).collect()}
    assert sorted(read) == expected(TREE) and read["_b.TSX"] == "" and read["src/c.Js"] == "1\r\n2" and read["src/deep/er/d.py"].endswith(" ok") and read["sp ace/ä ö.ts"] == "u"


def test_partitions_and_conditions(spark, tmp_path):
    root = made(tmp_path / "t", {f"p{i}/q{j}/f{k}.{e}": b"x" * k for i in range(4) for j in range(3) for k in range(3) for e in ("ts", "css")})
    reader = tree.TreeReader(str(root), 10)
    parts = reader.partitions()
    assert {(p.rel, p.deep) for p in parts} >= {("", False), ("p0/", False), ("p0/q0/", True)} and len(parts) == 1 + 4 + 12
    assert [(p.rel, p.deep) for p in tree.TreeReader(str(root), 1).partitions()] == [("", True)]
    some = tree.manifest(spark, str(root), ("TS",), up_to=1)
    assert sorted(r.rel for r in some.collect()) == sorted(f"p{i}/q{j}/f{k}.ts" for i in range(4) for j in range(3) for k in range(2))
    every = tree.manifest(spark, str(root))
    counts = [every.count(), files.source_files(every, ("TS",), max_bytes=1).count(), tree.manifest(spark, str(root), over=1).count(), every.count()]
    assert counts == [72, 24, 24, 72]  # one query's conditions do not stay for the next one
    over = files.oversized_build_files(tree.manifest(spark, str(made(tmp_path / "u", {"dist/a.js": b"12345", "dist/b.js": b"1", "c.js": b"12345"}))), 2, 10)
    assert [r.rel for r in over.collect()] == ["dist/a.js"]


def test_odd_roots(spark, tmp_path):
    root = made(tmp_path / "t", {"a.ts": b"x"})
    assert tree.manifest(spark, str(root / "a.ts")).count() == 0
    assert tree.manifest(spark, str(tmp_path / "none")).count() == 0
    (root / "gone.ts").write_bytes(b"y")
    listed = tree.manifest(spark, str(root)).collect()
    os.remove(root / "gone.ts")
    again = spark.createDataFrame(listed, tree.MANIFEST)
    assert [r.rel for r in files.read_contents(again).collect()] == ["a.ts"]
    assert files.read_contents(again.where(F.lit(False))).count() == 0
