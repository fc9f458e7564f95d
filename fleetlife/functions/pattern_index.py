"""Which of many patterns can be found in which of many strings: an equi-join on a trigram every match has to contain."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3
TOKEN = re.compile(r"\\.|\{\d+(?:,\d*)?\}|.", re.DOTALL)


def required_literals(pattern: str) -> list[str] | None:
    """Strings one of which is in whatever the pattern matches: for every alternative the longest run of plain characters
    outside groups and classes. None where some alternative has no run of three characters, or the pattern switches flags,
    quotes, has brackets that do not close or a class that begins with its own bracket. Fewer literals than there are only cost time, so whatever is unsure ends a run.
    """
    if re.search(r"\(\?[a-zA-Z-]|\\[QEcxuNp0-9]|\[\^?\]", pattern):
        return None
    found, best, run = [], "", ""
    depth = in_class = 0  # open groups; open brackets of a class, which may hold classes

    def end() -> None:
        nonlocal best, run
        best, run = max(best, run, key=len), ""

    for token in TOKEN.findall(pattern):
        if in_class:
            in_class += (token == "[") - (token == "]")
        elif token == "[":
            end()
            in_class = 1
        elif token in ("(", ")"):
            end()
            depth += 1 if token == "(" else -1
        elif depth:
            continue
        elif token == "|":
            end()
            found.append(best)
            best = ""
        elif token in ("?", "*") or len(token) > 1 and token[0] == "{":
            run = run[:-1]  # the last character may be missing
            end()
        elif token in "+.^$" or len(token) > 1 and token[1].isalnum():
            end()
        else:
            run += token[-1]
    end()
    found.append(best)
    return None if depth or in_class or min(map(len, found)) < GRAM else found


def grams(item: Column) -> Column:
    """The distinct pieces of three characters of a string."""
    at = F.sequence(F.lit(1), F.length(item) - GRAM + 1)
    return F.when(F.length(item) >= GRAM, F.array_distinct(F.transform(at, lambda i: F.substring(item, i, F.lit(GRAM)))))


def indexed_patterns(patterns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From (_id, _rx): (_id, _rx, _literal, _gram) of each alternative of the patterns that can be indexed, by the trigram of
    the literal that is rarest among all literals; and (_id, _rx) of the patterns that have to be tried on every string."""
    @F.pandas_udf("array<string>")
    def literals(rx: pd.Series) -> pd.Series:
        return rx.map(required_literals)

    known = patterns.withColumn("_literals", literals("_rx"))
    always = known.where(F.col("_literals").isNull()).select("_id", "_rx")
    parts = known.select("_id", "_rx", F.explode("_literals").alias("_literal")).distinct()
    pieces = parts.withColumn("_gram", F.explode(grams(F.col("_literal"))))
    common = pieces.groupBy("_gram").agg(F.count("*").alias("_count"))
    rare = pieces.join(common, "_gram").groupBy("_id", "_rx", "_literal").agg(
        F.min(F.struct("_count", "_gram"))["_gram"].alias("_gram"))
    return rare, always


def candidates(names: DataFrame, rare: DataFrame) -> DataFrame:
    """(_name, _id, _rx): strings beside the indexed patterns one of whose literals they contain; each pair may come once for
    every alternative."""
    pieces = names.select("_name", F.explode(grams(F.col("_name"))).alias("_gram"))
    return pieces.join(rare, "_gram").where(F.contains("_name", "_literal")).select("_name", "_id", "_rx")
