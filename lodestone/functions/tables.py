"""Chunkers and other table functions for SQL: ``register(spark)``, then lateral joins.

    SELECT d.doc_id, c.* FROM docs d, LATERAL chunks(d.text, 'markdown', 1024, 128) c

``chunks`` is polymorphic: with ``extra => true`` its result has the kind of each chunk's first block and its
estimated tokens too, which it says when the query is analysed. Its results are those of ``create_chunks``, row by
row in Python; the DataFrame operators are faster on whole tables. Scalar functions of the engine are registered beside it.

Defined results: a null text, or one without words, has no chunk; an unknown strategy is taken as recursive, as in
``create_chunks``; a constant is asked for every argument but the text.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from lodestone.operators import chunking

#: Scalar functions, as SQL: name, parameters and body.
SCALARS = {
    "content_hash": ("t STRING", "sha2(CAST(t AS BINARY), 256)"),
    "tokens_estimate": ("t STRING", "greatest(1L, CAST(floor(length(t) / 4) AS BIGINT))"),
    "strip_context": ("t STRING", r"regexp_replace(t, '^\\[Context:.*?\\]\\s*', '')"),
}


class Chunks:
    @staticmethod
    def analyze(text: AnalyzeArgument, strategy: AnalyzeArgument | None = None, size: AnalyzeArgument | None = None, overlap: AnalyzeArgument | None = None, extra: AnalyzeArgument | None = None) -> AnalyzeResult:
        if text.dataType != StringType():
            raise ValueError("chunks: the text must be a string")
        for name, a in (("strategy", strategy), ("size", size), ("overlap", overlap), ("extra", extra)):
            if a is not None and not a.isConstantExpression:
                raise ValueError(f"chunks: {name} must be a constant")
        schema = StructType().add("chunk_index", IntegerType()).add("content", StringType()).add("section_header", StringType())
        if extra is not None and extra.value:
            schema = schema.add("kind", StringType()).add("tokens", IntegerType())
        return AnalyzeResult(schema)

    def eval(self, text: str | None, strategy: str = "recursive", size: int = 1024, overlap: int = 128, extra: bool = False) -> Iterator[tuple]:
        for i, content, header in chunking.split(text, strategy, size, overlap):
            yield (i, content, header, *((chunking.kind(content), max(1, len(content) // 4)) if extra else ()))


def register(spark: SparkSession) -> None:
    """Makes ``chunks`` and the scalar functions known to SQL in this session."""
    from pyspark.sql.functions import udtf

    spark.udtf.register("chunks", udtf(Chunks))
    for name, (parameters, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURN {body}")
