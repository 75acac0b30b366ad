"""An embedding model as a table function of SQL: rows in, vectors out, a few texts a call.

    SELECT * FROM embed(TABLE(SELECT Id, Content FROM chunks) PARTITION BY pmod(hash(Id), 64))

The function takes a table with columns ``Id`` and ``Content`` and gives ``Id, Vector,
Error`` of every row. Texts go to the model in calls of at most ``batch``, which is 1 to 5.
A call that fails, or gives another number of vectors than it got texts, or a vector of
another dimension, fails its own rows only: they come back without a vector and with the
reason. So vectors and errors together are exactly as many as the rows.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..table import Embedder

MAX_BATCH = 5
OUT = T.StructType([T.StructField("Id", T.StringType()), T.StructField("Vector", T.ArrayType(T.FloatType())), T.StructField("Error", T.StringType())])


def register(spark: SparkSession, embedder: Embedder, name: str = "embed", batch: int = MAX_BATCH) -> None:
    """Make ``embedder`` the table function ``name`` of this session."""
    if not 1 <= batch <= MAX_BATCH:
        raise ValueError(f"a call takes 1 to {MAX_BATCH} texts")
    from pyspark.sql.functions import udtf

    class Embed:
        def __init__(self):
            self.ids, self.texts = [], []

        @staticmethod
        def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
            names = [f.name for f in rows.dataType.fields] if rows.isTable else []
            if not {"Id", "Content"} <= set(names):
                raise ValueError("a table with the columns Id and Content is asked for")
            return AnalyzeResult(OUT)

        def eval(self, row):
            self.ids.append(row["Id"])
            self.texts.append(row["Content"] or "")
            if len(self.ids) == batch:
                yield from self.answered()

        def terminate(self):
            yield from self.answered()

        def answered(self):
            ids, texts = self.ids, self.texts
            self.ids, self.texts = [], []
            if not ids:
                return
            try:
                vectors, error = embedder.embed(texts, "RETRIEVAL_DOCUMENT"), None
                if len(vectors) != len(texts):
                    error = f"{len(vectors)} vectors for {len(texts)} texts"
                elif any(len(v) != embedder.dimension for v in vectors):
                    error = "a vector of another dimension"
            except Exception as failed:
                error = str(failed)[:200] or type(failed).__name__
            for k, id_ in enumerate(ids):
                yield id_, None if error else [float(x) for x in vectors[k]], error

    spark.udtf.register(name, udtf(Embed))
