"""The ignore language against the version control program itself, on fixed and on random files."""

from __future__ import annotations

import random
import shutil
import subprocess

import pytest

from tarnfall.sources import ignore_rules

FILES = [
    {
        ".gitignore": "# a comment\n\n*.log\n!keep.log\n/build\nnode/\ndoc/*.txt\n**/cache\nlogs/**\na/**/b\n\\#odd\n\\!odd\nsp ace\ntrail   \nesc\\ \n[!x]y[0-9].c\nq?.t\n*.tar.gz\n",
        "sub/.gitignore": "!a.log\n/only\ndeep/\n*.tmp\n!/x.tmp\n",
        "sub/deep/.gitignore": "!*\n",
        "x.log/.gitignore": "!back\n",
    },
    {".gitignore": "*\n!*/\n!*.md\n!/keep/**\nsecret.md\n"},
    {".gitignore": "/*\n!/src/\n/src/*\n!/src/a\nfoo/bar\n**/z/**/w.txt\n[[:digit:]]*.d\nab[c-e]/\n*.e[xy]\n"},
    {"p/q/.gitignore": "*.o\r\n!main.o\r\nr/s\r\n/t\r\n"},
]
PATHS = [
    "a.log", "keep.log", "sub/a.log", "sub/b.log", "build/x", "sub/build/x", "build", "node/x", "sub/node", "doc/a.txt", "doc/x/a.txt", "sub/doc/a.txt", "cache", "u/v/cache/w", "logs/a/b", "logs", "a/b", "a/x/b",
    "a/x/y/b/z", "#odd", "!odd", "sp ace", "trail", "esc ", "esc", "zy1.c", "xy1.c", "u/zy1.c", "q1.t", "q.t", "sub/only", "sub/u/only", "sub/deep/a.md", "sub/x.tmp", "sub/u/x.tmp", "sub/deep/x.tmp", "k.tar.gz", "u/k.tar.gz",
    "k.gz", "x.log/back", "readme.md", "u/v/readme.md", "u/secret.md", "keep/a/b.c", "other.c", "src/a", "src/a/x", "src/b", "src/b/x", "foo/bar", "u/foo/bar", "src/a/foo/bar", "z/w.txt", "u/z/a/b/w.txt", "1a.d", "a1.d",
    "abc/x", "abf/x", "src/a/abd/x", "m.ex", "m.ez", "p/q/a.o", "p/q/main.o", "p/a.o", "p/q/r/s", "p/q/u/r/s", "p/q/t", "p/q/u/t", "p/q/u/main.o",
]


def known(folder, files, paths) -> set[str]:
    """What the program says of paths that need not be there: files, unless a path below them is asked too."""
    subprocess.run(["git", "init", "-q", str(folder)], check=True)
    folders = {p.rpartition("/")[0] for p in [*files, *paths]}
    folders |= {f[:i] for f in folders for i, c in enumerate(f) if c == "/"}
    for path in [*files, *paths]:
        at = folder / path
        at.parent.mkdir(parents=True, exist_ok=True)
        if path not in folders:
            at.write_bytes(files.get(path, "").encode())
    asked = [p for p in paths if p not in folders]
    done = subprocess.run(["git", "-C", str(folder), "check-ignore", "-z", "--stdin", "--no-index"], input="\0".join(asked).encode(), capture_output=True)
    assert done.returncode in (0, 1), done.stderr
    return {x for x in done.stdout.decode().split("\0") if x}, asked


def random_case(rng):
    names = ["a", "b", "ab", "a.c", "b.c", "a.b.c", "[a]"]
    some = lambda n: "/".join(rng.choice(names) for _ in range(rng.randrange(1, n + 1)))

    def line():
        body = "/".join(rng.choice([*names[:-1], "*", "a*", "*.c", "?", "[ab]", "[!a]", "**", "*.b.c"]) for _ in range(rng.randrange(1, 4)))
        return rng.choice(["", "", "!"]) + rng.choice(["", "", "/"]) + body + rng.choice(["", "", "/"])

    files = {f"{d}.gitignore": "\n".join(line() for _ in range(rng.randrange(1, 6))) for d in {"", rng.choice(["a/", "ab/", "b/a/", ""])}}
    return files, sorted({some(4) for _ in range(40)})


@pytest.mark.skipif(not shutil.which("git"), reason="needs the program to compare with")
def test_as_the_program_says(spark, tmp_path):
    rng = random.Random(5)
    cases = [(f, PATHS) for f in FILES] + [random_case(rng) for _ in range(60)]
    rows, asked, expected = [], [], set()
    for k, (files, paths) in enumerate(cases):
        folders = {f"{'/'.join(p.split('/')[:i])}" for p in paths for i in range(1, p.count("/") + 1)}
        files = {f: t for f, t in files.items() if f.rpartition("/")[0] not in set(paths) - folders}
        found, own = known(tmp_path / str(k), files, paths)
        rows += [(k, f, t) for f, t in files.items()]
        asked += [(k, p) for p in own]
        expected |= {(k, p) for p in found}
    got = ignore_rules.ignored(spark.createDataFrame(asked, "k int, file string"), spark.createDataFrame(rows, "k int, rel string, content string"), "k")
    got = {tuple(r) for r in got.collect()}
    wrong = sorted(got ^ expected)
    assert not wrong, [(k, p, cases[k][0]) for k, p in wrong[:5]]
    assert 100 < len(expected) < len(asked)


def test_odd_rows(spark):
    paths = spark.createDataFrame([(None,), ("a.log",), ("a.log",), ("b/a.log",), ("",)], "file string")
    none = spark.createDataFrame([(".gitignore", None), ("b/.gitignore", "")], "rel string, content string")
    assert ignore_rules.ignored(paths, none).collect() == []
    files = spark.createDataFrame([(".gitignore", "*.log\n!\n/\n"), ("x.py", "*.log")], "rel string, content string")
    assert sorted(r.file for r in ignore_rules.ignored_below(files, paths).collect()) == ["a.log", "b/a.log"]
    tracked = spark.createDataFrame([("b/a.log",)], "file string")
    assert [r.file for r in ignore_rules.ignored(paths, files.limit(1), tracked=tracked).collect()] == ["a.log"]
