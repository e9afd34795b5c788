"""What Unicode needs Python for: compatibility normalisation, as an Arrow-batched function."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col


def cleaned(c: Column | str) -> Column:
    """NFKC; other control characters are spaces; spaces are squeezed per line; two line ends at most in a row. Null is empty."""
    from ..operators.sections import clean

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: clean(None if t is None or t is pd.NA else t))

    return run(col(c))


def local_timestamp(moment: Column | str, offset: str = "-05:00") -> Column:
    """ISO 8601 to the second in a fixed offset, from a UTC timestamp."""
    return F.concat(F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(offset), col(moment).cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss"), F.lit(offset))
