"""SQL table function over one text: SELECT t.* FROM docs, LATERAL tokenize(text) t."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from .text import TOKEN


class Tokenize:
    """ix, surface, start, end of English tokens; the DataFrame form is functions.text.tokens."""

    def eval(self, text: str):
        for ix, m in enumerate(re.finditer(TOKEN, text or "")):
            yield ix, m.group(), m.start(), m.end()


def register(spark: SparkSession, name: str = "tokenize") -> None:
    spark.udtf.register(name, udtf(Tokenize, returnType="ix int, surface string, start int, end int"))
