"""The chunk table: schema, bounds and validation as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIMENSION = 3072
MAX_CONTENT_BYTES = 2 << 20
MAX_CHILDREN = 10_000

CHUNK = T.StructType(
    [
        T.StructField("Id", T.StringType(), False),
        T.StructField("Content", T.StringType(), False),
        T.StructField("Vector", T.ArrayType(T.FloatType(), False)),
        T.StructField("ChunkType", T.StringType(), False),
        T.StructField("SessionId", T.StringType(), False),
        T.StructField("ProjectPath", T.StringType(), False),
        T.StructField("ProjectName", T.StringType(), False),
        T.StructField("Timestamp", T.TimestampType(), False),
        T.StructField("UserUuid", T.StringType()),
        T.StructField("AssistantUuid", T.StringType()),
        T.StructField("FilePath", T.StringType()),
        T.StructField("Operation", T.StringType()),
        T.StructField("Model", T.StringType()),
        T.StructField("SourceFile", T.StringType(), False),
        T.StructField("SourceLine", T.LongType(), False),
        T.StructField("ParentChunkId", T.StringType()),
        T.StructField("ChildChunkIds", T.ArrayType(T.StringType())),
        T.StructField("MachineId", T.StringType()),
    ]
)
RESULT_COLUMNS = ["Id", "Content", "ChunkType", "SessionId", "ProjectPath", "ProjectName", "Timestamp", "FilePath", "Operation", "SourceFile"]

#: Largest size in bytes of each text column, and whether it must be there.
TEXT_BOUNDS = {
    "Id": (64, True),
    "Content": (MAX_CONTENT_BYTES, True),
    "ChunkType": (32, True),
    "SessionId": (128, True),
    "ProjectPath": (8192, True),
    "ProjectName": (256, True),
    "SourceFile": (8192, True),
    "UserUuid": (128, False),
    "AssistantUuid": (128, False),
    "FilePath": (8192, False),
    "Operation": (32, False),
    "Model": (256, False),
    "ParentChunkId": (64, False),
    "MachineId": (256, False),
}
OPTIONAL_TEXT = [name for name, (_, required) in TEXT_BOUNDS.items() if not required]


def vector_error(vector: str | Column, dimension: int = DIMENSION) -> Column:
    """Why a vector is invalid, or null: its size, a component that isn't finite, or all near zero."""
    v = F.col(vector) if isinstance(vector, str) else vector
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        F.when(F.size(v) != dimension, "vector_dimension")
        .when(~F.coalesce(finite, F.lit(False)), "vector_not_finite")
        .when(~F.exists(v, lambda x: F.abs(x) >= 1e-10), "vector_zero")
    )


def chunk_errors(dimension: int = DIMENSION) -> Column:
    """All violations of a chunk row, as an array of names; empty for a valid row."""
    checks = []
    for name, (most, required) in TEXT_BOUNDS.items():
        size = F.octet_length(F.col(name))
        if required:
            checks.append(F.when(F.coalesce(size, F.lit(0)) == 0, f"{name}_missing"))
        checks.append(F.when(size > most, f"{name}_too_long"))
    checks += [
        F.when(F.col("Timestamp").isNull(), "Timestamp_missing"),
        F.when(F.coalesce(F.col("SourceLine"), F.lit(-1)) < 0, "SourceLine_negative"),
        F.when(F.size("ChildChunkIds") > MAX_CHILDREN, "ChildChunkIds_too_many"),
        F.when(F.exists("ChildChunkIds", lambda x: ~F.coalesce(F.octet_length(x), F.lit(0)).between(1, 64)), "ChildChunkIds_bad"),
        F.when(F.col("Vector").isNotNull(), vector_error("Vector", dimension)),
    ]
    return F.array_compact(F.array(*checks))


def normalized(chunks: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Empty optional text becomes null, columns take the table's order; missing ones are null.

    Of other columns those in ``keep`` stay.
    """
    have = set(chunks.columns)
    out = [F.col(name) for name in keep]
    for field in CHUNK.fields:
        col = F.col(field.name) if field.name in have else F.lit(None)
        if field.name in OPTIONAL_TEXT:
            col = F.nullif(col.cast("string"), F.lit(""))
        if field.name == "Vector" and field.name in have:
            # a missing component isn't finite, so that the row is refused
            col = F.transform(col.cast("array<float>"), lambda x: F.coalesce(x, F.lit(float("nan")).cast("float")))
        out.append(col.cast(field.dataType).alias(field.name))
    return chunks.select(out[len(keep) :] + out[: len(keep)])
