"""Names for SQL users."""
from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession, functions as F, types as T

from lectern.functions import kernels
from lectern.functions.text import canon_udf
from lectern.operators.responses import clean_json_udf

MAP_TYPE = T.StructType([T.StructField("text", T.StringType()), T.StructField("map", T.ArrayType(T.IntegerType()))])


@F.pandas_udf(MAP_TYPE)
def canon_map_udf(texts: pd.Series) -> pd.DataFrame:
    """Canonical text and, per canonical character, the source position it came from."""
    rows = [(None, None) if s is None else (kernels.canon_text(s), kernels.canon_offsets(s).tolist()) for s in texts]
    return pd.DataFrame(rows, columns=["text", "map"])


NEAR_TYPE = T.StructType([T.StructField("distance", T.IntegerType()), T.StructField("end", T.IntegerType())])


@F.pandas_udf(NEAR_TYPE)
def best_substring_udf(hays: pd.Series, needles: pd.Series) -> pd.DataFrame:
    """Least edit distance of the needle to a substring of the text, and where that substring ends."""
    rows = [(None, None) if h is None or not n else kernels.substring_distance(h, n) for h, n in zip(hays, needles)]
    return pd.DataFrame(rows, columns=["distance", "end"]).astype("Int32")


def register(spark: SparkSession) -> None:
    for name, function in (("canon", canon_udf), ("canon_map", canon_map_udf), ("best_substring", best_substring_udf),
                           ("extract_json", clean_json_udf)):
        spark.udf.register(name, function)
