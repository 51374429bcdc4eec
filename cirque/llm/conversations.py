"""What the operators on conversations share: the order of turns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def placed(turn: str, role: str, text: str) -> list[Column]:
    """Columns o1.. that put a conversation's rows in order: by turn, null first, then role, the text's first 64 characters and its MD5.

    Rows that are equal in all of them are equal in turn, role and text, so their order among themselves means nothing.
    """
    return [
        F.col(turn).isNotNull().alias("o1"), F.coalesce(F.col(turn), F.lit(0)).alias("o2"), F.col(role).alias("o3"), F.substring(text, 1, 64).alias("o4"), F.md5(F.col(text).cast("binary")).alias("o5"),
    ]


ORDER = ["o1", "o2", "o3", "o4", "o5"]
