"""Functions that Spark has no built-in for, as Pandas UDFs (type hints are objects here, which Spark reads)."""

import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def canonical_json(s: pd.Series) -> pd.Series:
    """A JSON text with sorted keys, no blanks and other letters kept as they are; null where it isn't JSON. Spark's own writer keeps the order."""

    def one(x):
        try:
            return None if x is None else json.dumps(json.loads(x), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            return None

    return s.map(one)
