"""POSIX paths as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def resolved(base: Column, path: Column) -> Column:
    """``path`` seen from the absolute directory ``base``, with . and .. folded."""
    whole = F.when(path.startswith("/"), path).otherwise(F.concat_ws("/", base, path))

    def fold(acc: Column, part: Column) -> Column:
        up = F.when(F.size(acc) > 0, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(acc)
        return F.when(part.isin("", "."), acc).when(part == "..", up).otherwise(F.concat(acc, F.array(part)))

    return F.concat(F.lit("/"), F.array_join(F.aggregate(F.split(whole, "/"), F.array().cast("array<string>"), fold), "/"))


def ancestors(path: Column) -> Column:
    """The absolute path and all its parents but the root, longest first."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.when(F.size(parts) > 0, F.transform(F.sequence(F.size(parts), F.lit(1)), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), n), "/")))).otherwise(F.array().cast("array<string>"))


def depth(path: Column) -> Column:
    return F.size(F.filter(F.split(path, "/"), lambda p: p != ""))


def relative(base: Column, path: Column) -> Column:
    """``path`` as seen from ``base``, both absolute; "." for base itself."""
    a, b = (F.filter(F.split(p, "/"), lambda x: x != "") for p in (base, path))
    shared = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.least(F.size(a), F.size(b)), F.lit(1))), lambda n: (n <= F.least(F.size(a), F.size(b))) & (F.slice(a, F.lit(1), n) == F.slice(b, F.lit(1), n))))
    ups = F.array_repeat(F.lit(".."), F.size(a) - shared)
    out = F.array_join(F.concat(ups, F.slice(b, shared + 1, F.greatest(F.size(b) - shared, F.lit(0)))), "/")
    return F.when(out == "", ".").otherwise(out)


def _places(paths: Column, kb_dir: Column) -> Column:
    """Those of ``paths`` that are not blank, as structs of what was given and where it lies, seen from ``kb_dir``."""
    named = F.filter(paths, lambda p: F.regexp_replace(p, r"\s+", "") != "")
    return F.transform(named, lambda p: F.struct(p.alias("given"), resolved(kb_dir, p).alias("path")))


def _inside(path: Column, kb_dir: Column, mask: Column) -> Column:
    under = lambda d: (path == d) | path.startswith(F.concat(d, F.lit("/")))
    return under(kb_dir) & ~F.coalesce(under(mask), F.lit(False))


def kept_within(paths: Column, kb_dir: Column, mask: Column | None = None) -> Column:
    """Those of ``paths`` in the subtree of ``kb_dir`` but not of ``mask``, as seen from ``kb_dir``, each once and in order."""
    mask = F.lit(None).cast("string") if mask is None else mask
    return F.array_distinct(F.transform(F.filter(_places(paths, kb_dir), lambda p: _inside(p["path"], kb_dir, mask)), lambda p: relative(kb_dir, p["path"])))


def dropped_outside(paths: Column, kb_dir: Column, mask: Column | None = None) -> Column:
    """Those of ``paths`` that ``kept_within`` leaves out, as given; blank ones are neither kept nor dropped."""
    mask = F.lit(None).cast("string") if mask is None else mask
    return F.transform(F.filter(_places(paths, kb_dir), lambda p: ~_inside(p["path"], kb_dir, mask)), lambda p: p["given"])
