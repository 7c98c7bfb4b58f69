"""Dependency expansion: follow names in block metadata to the blocks they name."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.session import stage

# The metadata that is followed and the name it is resolved by,
# in the order in which matches are reported.
FOLLOWED = [
    ("class_name", ["injects", "implements", "extends"]),
    ("component_name", ["calls_components"]),
]
_KEYS = ["id", "file_path", "start_line", "ordinal"]
ORDER = ["level", "via", "file_path", "start_line", "ordinal", "id"]
_LINKS = ["injects", "implements", "extends", "calls_components"]

SLIM = [*_KEYS, *[by for by, _ in FOLLOWED], *_LINKS]


def _references(layer: DataFrame) -> DataFrame:
    """Distinct (via, name) pairs a layer of blocks refers to."""

    def names(field: str) -> Column:
        listed = isinstance(layer.schema[field].dataType, T.ArrayType)
        value = F.col(field) if listed else F.when(F.col(field) != "", F.array(field))
        return F.coalesce(value, F.array().cast("array<string>"))

    def tagged(via: int, fields: list[str]) -> Column:
        every = F.concat(*map(names, fields))
        return F.transform(every, lambda n: F.struct(F.lit(via).alias("via"), n.alias("name")))

    pairs = [tagged(via, fields) for via, (_, fields) in enumerate(FOLLOWED)]
    return layer.select(F.explode(F.concat(*pairs)).alias("ref")).select("ref.via", "ref.name").distinct()


def named_rows(slim: DataFrame, *more: str) -> DataFrame:
    """Index rows once per name they answer to: keys, links, ``via`` and ``name``."""
    answers = F.filter(
        F.array(
            *[
                F.struct(F.lit(via).alias("via"), F.col(by).alias("name"))
                for via, (by, _) in enumerate(FOLLOWED)
            ]
        ),
        lambda a: a["name"].isNotNull(),
    )
    return slim.select(*_KEYS, *_LINKS, *more, F.explode(answers).alias("answer")).select(
        *_KEYS, *_LINKS, *more, "answer.via", "answer.name"
    )


def reach(index: DataFrame, seeds: DataFrame, depth: int) -> DataFrame | None:
    """Keys, ``level`` and ``via`` of the blocks reached from ``seeds``; None if there are none.

    Each level is one pass over names and keys and is staged, so lineage does
    not grow and contents are never read. A name held by very many blocks only
    lengthens the probe side of its join.
    """
    slim = index.select(*SLIM)
    named = named_rows(slim)
    layer = stage(slim.join(seeds.select("id").distinct(), "id", "left_semi"), "seeds")
    return _levels(layer, lambda wanted: named, depth)


def _levels(
    layer: DataFrame, names: Callable[[DataFrame], DataFrame], depth: int
) -> DataFrame | None:
    seen = layer.select("id")
    levels: list[DataFrame] = []
    for level in range(1, depth + 1):
        wanted = _references(layer)
        hits = names(wanted).join(wanted, ["via", "name"], "left_semi")
        # A row found both ways counts as found by class.
        once = hits.groupBy("id").agg(
            F.min("via").alias("via"), *[F.first(c).alias(c) for c in _KEYS[1:] + _LINKS]
        )
        layer = stage(once.join(seen, "id", "left_anti").withColumn("level", F.lit(level)), "level")
        if layer.isEmpty():
            break
        levels.append(layer.select(*_KEYS, "level", "via"))
        seen = seen.unionByName(layer.select("id"))
    return reduce(DataFrame.unionByName, levels) if levels else None


def reach_stored(
    names: Callable[[DataFrame], DataFrame], seeds: DataFrame, depth: int
) -> DataFrame | None:
    """:func:`reach` over a stored table of names; no level reads the index.

    ``seeds`` are whole rows, so what they refer to is known. ``names`` gives
    the stored rows that may answer to the (via, name) pairs it is given.
    """
    layer = stage(seeds.select(*_KEYS, *_LINKS), "seeds")
    return _levels(layer, names, depth)


def expand_dependencies(index: DataFrame, seeds: DataFrame, depth: int = 1) -> DataFrame:
    """Blocks reached from ``seeds`` in at most ``depth`` levels, seeds left out.

    Adds ``level`` and ``via`` (0 found as a class, 1 as a component). Order:
    level, via, file_path, start_line. A block counts at its first level only;
    names that resolve to nothing are ignored.
    """
    rows = index.drop("embedding")
    reached = reach(index, seeds, depth)
    if reached is None:
        return rows.where(F.lit(False)).withColumns({"level": F.lit(0), "via": F.lit(0)})
    return rows.join(reached.select("id", "level", "via"), "id").orderBy(*ORDER)
