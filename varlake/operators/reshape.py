"""Reshaping nested frames."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varlake.functions._columns import quoted
from varlake.functions.text import field_name_normaliser

#: A leaf's path: a field name steps into a struct, ``None`` steps into the elements of an array.
Path = tuple[str | None, ...]


def display_head(df: DataFrame, nrows: int = 5) -> pd.DataFrame:
    """The first ``nrows`` rows, in no particular order, as a pandas frame."""
    return df.limit(nrows).toPandas()


def zip_explode_cols(
    df: DataFrame,
    cols: Sequence[str],
    result_name: str,
    rename_fields: Mapping[str, str] | None = None,
    outer: bool = False,
) -> DataFrame:
    """One row per position of the zipped arrays, as the struct column ``result_name``.

    Shorter arrays are padded with nulls. Rows whose arrays are null or empty vanish unless ``outer`` is set. The
    array columns are kept; drop or deselect them and the optimiser will not copy them into the exploded rows.
    """
    names = rename_fields or {}
    zipped = F.arrays_zip(*[quoted(c).alias(names.get(c, c)) for c in cols])
    return df.withColumn(result_name, F.explode_outer(zipped) if outer else F.explode(zipped))


def _holds_struct(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.ArrayType):
        return _holds_struct(dtype.elementType)
    return isinstance(dtype, T.StructType)


def _leaf_paths(dtype: T.DataType) -> list[Path]:
    """Paths of all leaves below a type; arrays without structs inside are leaves themselves."""
    if isinstance(dtype, T.StructType):
        return [(field.name, *rest) for field in dtype.fields for rest in _leaf_paths(field.dataType)]
    if isinstance(dtype, T.ArrayType) and _holds_struct(dtype):
        return [(None, *rest) for rest in _leaf_paths(dtype.elementType)]
    return [()]


def _extract(value: Column, path: Path) -> Column:
    """Follow a path. The innermost array is read by field access, which Parquet pruning understands."""
    if not path:
        return value
    step, rest = path[0], path[1:]
    if step is not None:
        return _extract(value.getField(step), rest)
    if None in rest:
        return F.transform(value, lambda element: _extract(element, rest))
    return _extract(value, rest)


def _path_name(path: Path) -> str:
    """Struct levels are joined by a dot, array levels by an underscore."""
    levels = [[]]
    for step in path:
        if step is None:
            levels.append([])
        else:
            levels[-1].append(step)
    return "_".join(".".join(level) for level in levels)


def flatten(df: DataFrame, normaliser: Callable[[str], str] = field_name_normaliser()) -> DataFrame:
    """All struct leaves as top-level columns; an array of structs becomes one array column per leaf."""
    return df.select(
        *[
            _extract(quoted(path[0]), path[1:]).alias(normaliser(_path_name(path)))
            for path in _leaf_paths(df.schema)
        ]
    )


def _renamed(dtype: T.DataType, normaliser: Callable[[str], str]) -> T.DataType:
    if isinstance(dtype, T.ArrayType):
        return T.ArrayType(_renamed(dtype.elementType, normaliser), dtype.containsNull)
    if isinstance(dtype, T.StructType):
        return T.StructType(
            [T.StructField(normaliser(f.name), _renamed(f.dataType, normaliser), f.nullable) for f in dtype.fields]
        )
    return dtype


def normalise_field_names(df: DataFrame, normaliser: Callable[[str], str] = field_name_normaliser()) -> DataFrame:
    """Rename columns and all nested fields; the data is only re-typed, not copied."""
    target = _renamed(df.schema, normaliser)
    return df.select(
        *[quoted(old.name).cast(new.dataType).alias(new.name) for old, new in zip(df.schema.fields, target.fields)]
    )


def scalarise(df: DataFrame, cols: Mapping[str, str] | Sequence[str]) -> DataFrame:
    """Replace array columns by their first element (null when empty); a mapping also renames them."""
    targets = cols if isinstance(cols, Mapping) else {c: c for c in cols}
    return df.select(
        *[
            F.get(quoted(name), F.lit(0)).alias(targets[name]) if name in targets else quoted(name)
            for name in df.columns
        ]
    )


def scalarise_biallelic(df: DataFrame) -> DataFrame:
    """The usual one-element arrays of a biallelic variant table as scalars."""
    per_allele = ("INFO_AC", "INFO_AF", "INFO_MLEAC", "INFO_MLEAF")
    targets = {"alternateAlleles": "alternateAllele", **{name: name for name in per_allele}}
    return scalarise(df, {name: new for name, new in targets.items() if name in df.columns})


def shift_start(df: DataFrame, by: int = 1, column: str = "start") -> DataFrame:
    """Move between 0-based and 1-based coordinates."""
    return df.withColumn(column, F.col(column) + by)


def expand_struct(df: DataFrame, column: str) -> DataFrame:
    """Only the fields of one struct column."""
    return df.select(f"`{column}`.*")


def unstack_arrays(
    df: DataFrame, dim: str, values: Sequence[str], labels: str | None = None, missing: str | None = None
) -> DataFrame:
    """Dense arrays along one dimension → one row per observation.

    ``values`` are equally long arrays, ``labels`` the array of coordinate labels (positions are used without it).
    Rows whose ``missing`` flag is set are dropped. Apply it once per array dimension for higher-rank data.
    """
    arrays = [*values, *([missing] if missing else []), *([labels] if labels else [])]
    kept = [c for c in df.columns if c not in arrays]
    zipped = F.arrays_zip(*[quoted(c) for c in arrays])
    exploded = df.select(*[quoted(c) for c in kept], F.posexplode(zipped).alias("__pos", "__cell"))
    cell = F.col("__cell")
    if missing:
        exploded = exploded.filter(~F.coalesce(cell.getField(missing), F.lit(False)))
    label = cell.getField(labels) if labels else F.col("__pos")
    return exploded.select(
        *[quoted(c) for c in kept], label.alias(dim), *[cell.getField(v).alias(v) for v in values]
    )


def unstack_columns(
    df: DataFrame, index: Sequence[str], values: Sequence[str], dim: str, value: str, drop_null: bool = True
) -> DataFrame:
    """One column per coordinate → one row per observation; null cells count as missing."""
    long = df.unpivot([quoted(c) for c in index], [quoted(c) for c in values], dim, value)
    return long.filter(F.col(value).isNotNull()) if drop_null else long
