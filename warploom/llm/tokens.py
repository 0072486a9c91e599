"""What a token is: a longest run of letters, digits and underscores, or any other single character but white space."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = re.compile(r"\w+|[^\w\s]")
#: The same for the JVM, whose \\w and \\s are ASCII only.
JVM_TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x{1C}-\x{1F}\x{85}\p{Z}]"


def n_tokens(text: str | Column) -> Column:
    """Number of tokens of a text; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(JVM_TOKEN)), F.lit(0))
