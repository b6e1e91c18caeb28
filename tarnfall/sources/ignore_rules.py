"""Which paths version control ignores, from the ignore files themselves.

An ignore file holds one pattern a line and speaks for the paths below its folder. The lines become a table of rules; every
path is taken apart into itself and the folders above it, and each of these is joined with the rules of the folders above
it, by folder and by what the pattern's last name must be: a plain name, ``*.`` and an extension, or (for the few patterns
that end otherwise) anything. The last line that matches decides, deeper files after higher ones; a path below an ignored
folder is ignored whatever later lines say.

The language: ``#`` starts a comment and ``!`` takes back what an earlier line ignored, unless a backslash stands before; a
trailing slash means folders only; a slash anywhere else ties the pattern to its file's folder, else it holds at any depth;
``*`` and ``?`` and ``[..]`` match within a name, ``**/`` any folders, ``/**`` everything below; trailing spaces do not count unless
escaped. Tracked files, where they are known, are never ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfall.sources.tables import broadcast_if_small

IGNORE_FILE = ".gitignore"
#: Parts of a pattern, tried in this order: an escaped character, a class, stars and slashes, a question mark, another one.
TOKEN = r"(\\.|\[[!^]?\]?(?:\[:[a-z]+:\]|[^\]])*\]|/(?:\*\*/)+|^(?:\*\*/)+|/\*\*$|\*+|\?|.)"
#: Named classes within brackets.
CLASSES = {"alpha": "Alpha", "digit": "Digit", "alnum": "Alnum", "upper": "Upper", "lower": "Lower", "space": "Space", "punct": "Punct", "xdigit": "XDigit"}


def _translated(token: Column) -> Column:
    """One part of a pattern as a regular expression over a path relative to the file's folder."""
    literal = lambda c: F.concat(F.lit("\\Q"), c, F.lit("\\E"))
    inner = token
    for name, own in CLASSES.items():
        inner = F.replace(inner, F.lit(f"[:{name}:]"), F.lit(f"\\p{{{own}}}"))
    inner = F.regexp_replace(F.regexp_replace(inner, r"(?<!^)([\[&])", r"\\$1"), r"^\[[!^]", "[^/")
    return (
        F.when(token.rlike(r"^/(\*\*/)+$"), "/(?:.*/)?")
        .when(token.rlike(r"^(\*\*/)+$"), "(?:.*/)?")
        .when(token == "/**", "/.+")
        .when(token.rlike(r"^\*+$"), "[^/]*")
        .when(token == "?", "[^/]")
        .when(F.startswith(token, F.lit("\\")) & (F.length(token) == 2), literal(F.substring(token, 2, 1)))
        .when(F.startswith(token, F.lit("[")) & (F.length(token) > 2), inner)
        .otherwise(literal(token))
    )


def rules(ignore_files: DataFrame, *by: str) -> DataFrame:
    """The rules of ignore files (rel, content): their folder (ending in a slash, or empty), depth, line, pattern, whether
    they ignore, and whether they are for folders only. ``by``: columns that tell projects apart."""
    folder = F.regexp_replace("rel", r"[^/]*$", "")
    lines = ignore_files.select(*by, folder.alias("folder"), F.posexplode(F.split("content", r"\r?\n")).alias("line", "text"))
    text = F.regexp_replace("text", r"(?<!\\) +$", "")  # trailing spaces, unless escaped
    lines = lines.withColumn("text", text).where("text <> '' AND NOT startswith(text, '#')")
    back = F.col("text").startswith("!")
    lines = lines.withColumn("body", F.when(back, F.substring("text", 2, 1 << 30)).otherwise(F.col("text")))
    lines = lines.withColumn("only_folders", F.col("body").endswith("/")).withColumn("body", F.regexp_replace("body", "/$", ""))
    lines = lines.withColumn("tied", F.col("body").contains("/")).withColumn("body", F.regexp_replace("body", "^/", "")).where("body <> ''")
    whole = F.array_join(F.transform(F.regexp_extract_all("body", F.lit(TOKEN), F.lit(1)), _translated), "")
    regex = F.concat(F.lit("(?s)^"), F.when(F.col("tied"), "").otherwise("(?:.*/)?"), whole, F.lit("$"))
    depth = F.length("folder") - F.length(F.replace("folder", F.lit("/"), F.lit("")))
    last = F.element_at(F.split("body", "/"), -1)
    key = F.when(last.rlike(r"^(\*\.)?[^*?\[\\]+$"), last).otherwise("")
    return lines.select(*by, "folder", key.alias("key"), depth.cast("int").alias("depth"), "line", regex.alias("regex"), (~back).alias("ignores"), "only_folders")


def prefixes(rel: Column) -> Column:
    """Each folder above a path, ending in a slash, the empty one first."""
    parts = F.split(rel, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.when(k == 0, "").otherwise(F.concat(F.array_join(F.slice(parts, 1, k), "/"), F.lit("/"))))


def keys(path: Column) -> Column:
    """What a pattern that matches the path may end in: its name, ``*`` and each of its extensions, or anything."""
    name = F.element_at(F.split(path, "/"), -1)
    dots = F.split(name, r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(dots) - 1), lambda k: F.concat(F.lit("*."), F.array_join(F.slice(dots, k + 1, F.size(dots)), ".")))
    return F.array_distinct(F.concat(F.array(name, F.lit("")), F.when(F.size(dots) > 1, ends).otherwise(F.array().cast("array<string>"))))


def ignored(paths: DataFrame, ignore_files: DataFrame, *by: str, tracked: DataFrame | None = None) -> DataFrame:
    """The distinct ``by`` columns and ``file`` of the paths (file) that the ignore files (rel, content) ignore.

    tracked: paths under version control, which no rule ignores. A null path is ignored by nothing.
    """
    own = [*by, "file"]
    every = paths.select(*own).where("file IS NOT NULL").distinct()
    if tracked is not None:
        every = every.join(tracked.select(*own).distinct(), own, "left_anti")
    # the path and the folders above it, each judged by the rules of the folders above itself
    steps = every.select(*own, F.explode(F.concat(F.slice(prefixes(F.col("file")), 2, 1 << 20), F.array("file"))).alias("step"))
    steps = steps.withColumns({"is_folder": F.col("step").endswith("/"), "name": F.regexp_replace("step", "/$", "")})
    nodes = steps.select(*by, "name", "is_folder").distinct()  # a folder is judged once, however many files it holds
    judged = nodes.select("*", F.explode(prefixes(F.col("name"))).alias("folder")).select("*", F.explode(keys(F.col("name"))).alias("key"))
    known = broadcast_if_small(rules(ignore_files, *by))
    hits = judged.join(known, [*by, "folder", "key"]).where((F.col("is_folder") | ~F.col("only_folders")) & F.expr("rlike(substring(name, length(folder) + 1), regex)"))
    last = hits.groupBy(*by, "name", "is_folder").agg(F.max_by("ignores", F.struct("depth", "line")).alias("ignores")).where("ignores")
    return steps.join(last.select(*by, "name", "is_folder"), [*by, "name", "is_folder"], "left_semi").select(*own).distinct()


def ignored_below(files: DataFrame, paths: DataFrame, *by: str) -> DataFrame:
    """As :func:`ignored`, with the ignore files among the files that were read (rel, content)."""
    return ignored(paths, files.where(F.regexp_extract("rel", r"([^/]*)$", 1) == IGNORE_FILE).select(*by, "rel", "content"), *by)
