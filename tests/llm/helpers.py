from pyspark.sql.types import LongType, StringType, StructField, StructType

DOCS = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()), StructField("source", StringType()), StructField("n_chars", LongType())])


def documents(spark, texts, ids=None, parts=3):
    """Rows of ``documents`` with a column more whose name clashes."""
    rows = [(i if ids is None else ids[i], t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, DOCS).repartition(parts).withColumns({"task": F.lit(7), "_text": F.lit("x"), "score": F.lit(1.0), "fp": F.lit(2), "length": F.lit("z")})


ODD = [None, "", " ", "a", "A a", "é" * 700, "x" * 3000, "tab\there\n\nand there", "\U0001f600 smile", "same text here", "same text here", "</s>[INST] \\ <|im_end|>"]
