"""File sources and sinks (IO1, IO2).

CSV follows the common dialect on both sides: fields are quoted with ``"``,
a quote inside a field is doubled, line breaks inside a field are kept.  The
usual NA tokens become NULL, and NaN in floating columns becomes NULL, matching
how the reference's CSV reader treats missing cells.  Records or cells that
cannot be read raise an error, or are counted when asked for; none vanishes.
Parquet is the default sink.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.coerce import nan_to_null, qcol, text_to_double, trimmed

# FIXED VALUES: text that counts as a missing cell (the common CSV NA set).
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
             "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


# FIXED VALUES: text that counts as a truth value.
TRUTHS = {"True": True, "TRUE": True, "true": True, "False": False, "FALSE": False, "false": False}
_WHOLE = r"^\s*[+-]?[0-9]+\s*$"


def _fits(c: Column) -> dict[str, Column]:
    """Whether a cell's text is of each type, from the least type up."""
    return {"boolean": c.isin(*TRUTHS), "bigint": c.rlike(_WHOLE) & trimmed(c).try_cast("bigint").isNotNull(), "double": text_to_double(c).isNotNull()}


def _fit_counts(text: DataFrame, open_types: dict[str, Sequence[str]]) -> tuple[dict[str, int], dict[tuple[str, str], int]]:
    """Cells of each column, and those that fit each of its ``open_types``."""
    aggs = []
    for i, (name, kinds) in enumerate(open_types.items()):
        fits = _fits(qcol(name))
        aggs += [F.count(qcol(name)).alias(f"n{i}"), *[F.count_if(fits[kind]).alias(f"{kind}{i}") for kind in kinds]]
    row = text.agg(*aggs).first()
    return ({name: row[f"n{i}"] for i, name in enumerate(open_types)},
            {(name, kind): row[f"{kind}{i}"] for i, (name, kinds) in enumerate(open_types.items()) for kind in kinds})


#: Rows that ``infer_types`` looks at for types that are ruled out.
FIRST_ROWS = 1_000


def infer_types(text: DataFrame) -> dict[str, str]:
    """IO1: for each text column the least of boolean, bigint, double and string
    that fits all its cells but NULL; a column without cells is double.

    The counts of fitting cells add up, so this is one aggregate of the table,
    whatever its parts; whole numbers beyond 64 bits are double.  One cell that does not
    fit rules a type out, so types that a cell of ``FIRST_ROWS`` rows rules out are not
    tried on the others; every cell is tried for each type that may still be."""
    if not text.columns:
        return {}
    kinds = dict.fromkeys(text.columns, ("boolean", "bigint", "double"))
    some, fit = _fit_counts(text.limit(FIRST_ROWS), kinds)
    left = {name: [kind for kind in tried if fit[name, kind] == some[name]] for name, tried in kinds.items()}
    cells, fit = _fit_counts(text, left)
    return {name: "double" if not cells[name] else next((k for k in left[name] if fit[name, k] == cells[name]), "string")
            for name in text.columns}


def with_types(text: DataFrame, types: dict[str, str]) -> DataFrame:
    """The text columns of ``types`` as these types; every cell has to fit."""
    def as_type(name: str) -> Column:
        c = qcol(name)
        return {"boolean": F.lower(c) == "true", "bigint": trimmed(c).cast("bigint"), "double": text_to_double(c)}.get(types.get(name), c)

    return text.select(*[as_type(name).alias(name) for name in text.columns])


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
             multi_line: bool = False, bad_cells: str = "raise", infer: bool = False) -> DataFrame:
    """IO1: CSV with header; NA tokens and NaN → NULL.

    Every field is read as text; with a ``schema`` it is then cast, and without
    one ``infer`` asks for the least types that fit (``infer_types``).  A record
    with the wrong number of fields raises.  A cell that does not fit its type
    raises (``bad_cells='raise'``) or becomes NULL and is counted in an extra
    INT column ``bad_cells`` (``bad_cells='count'``).  ``multi_line`` allows
    line breaks inside quoted fields; a file is then one task, so large tables
    should come in many files."""
    reader = (spark.read.option("header", True).option("mode", "FAILFAST").option("quote", '"').option("escape", '"')
              .option("multiLine", multi_line))
    if schema is None:
        text = normalise_missing(reader.csv(path))
        return with_types(text, infer_types(text)) if infer else text
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    text = normalise_missing(reader.schema(T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])).csv(path))
    if bad_cells == "raise":
        return normalise_missing(text.select(*[qcol(f.name).cast(f.dataType).alias(f.name) for f in schema.fields]))
    if bad_cells != "count":
        raise ValueError(bad_cells)
    bad = sum(((qcol(f.name).isNotNull() & qcol(f.name).try_cast(f.dataType).isNull()).cast("int") for f in schema.fields), F.lit(0))
    return normalise_missing(text.select(*[qcol(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields],
                                         bad.alias("bad_cells")))


def normalise_missing(df: DataFrame) -> DataFrame:
    """NA tokens in text columns and NaN in floating columns → NULL."""
    out = []
    for f in df.schema.fields:
        c = qcol(f.name)
        if isinstance(f.dataType, T.StringType):
            out.append(F.when(c.isin(*NA_TOKENS), F.lit(None).cast("string")).otherwise(c).alias(f.name))
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            out.append(nan_to_null(c).cast(f.dataType).alias(f.name))
        else:
            out.append(c)
    return df.select(*out)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """IO2: CSV with header, one file per task (no single-writer funnel).
    Text is written exactly (Spark's writer would trim surrounding spaces);
    quotes inside a field are doubled, as other CSV readers expect."""
    (df.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .csv(path))


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite",
                  partition_by: list[str] | None = None) -> None:
    """Parquet sink, optionally partitioned by low-cardinality columns."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
