"""Names and types of the edge data model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What names an edge within a program: caller, place in the caller, callee.
KEY = ("method", "offset", "target")
#: One edge set is what a tool's configuration reported for a program.
CONFIG = ("tool", "config_id")
GROUP = ("program",)

EDGE = T.StructType([T.StructField("method", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("target", T.StringType())])
EDGE_TEXT = T.StructType([T.StructField(c, T.StringType()) for c in KEY])

TRUE, FALSE, UNKNOWN = 1, 0, -1


def edge_hash(*columns: str) -> Column:
    """A short join key for long string keys; always compare the columns too."""
    return F.xxhash64(*columns)
