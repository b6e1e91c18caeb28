"""Where a finding lives."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnfall.model import BUILD_DIRS, PRUNED_DIRS


def segments(path: Column) -> Column:
    return F.split(path, "/")


def in_build_output(path: Column) -> Column:
    return F.arrays_overlap(segments(path), F.array(*map(F.lit, BUILD_DIRS)))


def in_pruned(folder: Column) -> Column:
    return F.arrays_overlap(segments(folder), F.array(*map(F.lit, PRUNED_DIRS)))


def env_or_backup(path: Column) -> Column:
    """File names that version control usually ignores: backups, and .env files other than templates."""
    base = F.element_at(segments(path), -1)
    template = base.rlike(r"(?i)\.(example|sample|template|dist)$")
    return ~template & (base.rlike(r"(?i)(\.bak|\.orig|\.swp|~)$") | (base == ".env") | base.startswith(".env."))


def bucket(path: Column, ignored: Column) -> Column:
    """node_modules, build_output, gitignored or tracked, in this order of precedence."""
    packages = F.array_contains(segments(path), "node_modules")
    return F.when(packages, "node_modules").when(in_build_output(path), "build_output").when(ignored, "gitignored").otherwise("tracked")


def relative(uri: Column, target: str) -> Column:
    """A result's URI relative to the scanned folder: file URLs are decoded, backslashes become slashes, paths of one
    Windows drive compare without case, the folder itself is ``.``, null and empty are ``(unknown)``."""
    rest = F.regexp_replace(uri, r"^file://[^/]*", "")
    decoded = F.coalesce(F.try_url_decode(F.replace(rest, F.lit("+"), F.lit("%2B"))), rest)
    path = F.replace(F.when(uri.startswith("file://"), decoded).otherwise(uri), F.lit("\\"), F.lit("/"))
    path = F.when(path.rlike("^/[A-Za-z]:/"), F.substring(path, 2, 1 << 30)).otherwise(path)
    base = target.replace("\\", "/")
    windows = r"^(?:[A-Za-z]:/|//)"
    loose = path.rlike(windows) & F.lit(base).rlike(windows)
    mine = F.when(loose, F.lower(path)).otherwise(path)
    theirs = F.when(loose, F.lit(base.lower())).otherwise(F.lit(base))
    prefix = base if base.endswith("/") else base + "/"
    under = F.startswith(mine, F.when(loose, F.lit(prefix.lower())).otherwise(F.lit(prefix)))
    cut = F.when(mine == theirs, ".").when(under, F.substring(path, len(prefix) + 1, 1 << 30)).otherwise(path)
    return F.when(F.coalesce(uri, F.lit("")) == "", "(unknown)").otherwise(cut)
