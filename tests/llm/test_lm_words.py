"""Words of the language model are filtered and hashed as compiled code."""

import re

from glossmill.llm import lm
from pyspark.sql import functions as F


def test_word_counts_without_lambdas(spark, capsys):
    texts = ["a  b\tA\n", None, "", " \x0b\x0c ", "b", " É é a"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc long, text string")
    words = ["".join(c.lower() if c.isascii() else c for c in w) for t in texts for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
    own = {r.h: r.w for r in spark.createDataFrame([(w,) for w in set(words)], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    found = lm.word_counts(docs)
    assert {own[r.word]: r.f for r in found.collect()} == {w: words.count(w) for w in words}
    found.explain()
    assert "lambda" not in capsys.readouterr().out
