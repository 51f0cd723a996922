"""Shannon entropy of a text, in bits per UTF-16 unit."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _entropy(text: str | None) -> float | None:
    if text is None:
        return None
    if not text:
        return 0.0
    points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    top = int(points.max())
    if top < 0x10000:
        counts, units = np.bincount(points), len(points)
    else:
        counts = np.unique(points, return_counts=True)[1]
        units = len(points) + int((points >= 0x10000).sum())
    shares = counts[counts > 0] / units
    return float(-(shares * np.log2(shares)).sum())


# A text is a single cell, so counting its characters needs no shuffle.  Exploding it into one row
# per character and grouping gives the same number at many times the cost (see README).
# Texts are taken from the Arrow batch one at a time: Spark limits its bytes, and no copy of it is made.
@F.arrow_udf(T.DoubleType())
def shannon_entropy(texts: pa.Array) -> pa.Array:
    return pa.array((_entropy(t.as_py()) for t in texts), pa.float64())
