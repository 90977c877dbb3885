"""User-defined functions under registered names, and table functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf, udtf
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType


@pandas_udf(StringType())
def my_upper(s: pd.Series) -> pd.Series:
    return s.str.upper()


@pandas_udf(LongType())
def weighted_avg(value: pd.Series, weight: pd.Series) -> int:
    """Grouped aggregate: whole-number weighted average; null for no weight."""
    total = weight.sum()
    return int((value * weight).sum() // total) if total else None


@udtf(returnType=StructType().add("word", StringType()).add("length", IntegerType()))
class SplitWords:
    def eval(self, text: str, delimiter: str):
        for word in (text or "").split(delimiter):
            if word:
                yield word, len(word)


def register(spark: SparkSession) -> None:
    spark.udf.register("my_upper", my_upper)
    spark.udf.register("weighted_avg", weighted_avg)
    spark.udtf.register("split_words", SplitWords)


def dictionary_tokens(text: str, words: frozenset[str], longest: int) -> list[str]:
    """Longest match from the left against a dictionary; what it doesn't know comes letter by letter, blanks go."""
    out, at = [], 0
    while at < len(text):
        for n in range(min(longest, len(text) - at), 0, -1):
            if n == 1 or text[at : at + n] in words:
                if not text[at : at + n].isspace():
                    out.append(text[at : at + n])
                at += n
                break
    return out


#: Words of a dictionary that each worker holds, at most.
MOST_WORDS = 500_000


def dictionary_of(words: DataFrame) -> list[str]:
    """The distinct words of a frame's first column, as ``segmenter`` takes them; more than MOST_WORDS are an error."""
    found = [r[0] for r in words.where(F.length(words[0]) > 0).distinct().take(MOST_WORDS + 1)]
    if len(found) > MOST_WORDS:
        raise ValueError(f"a dictionary holds at most {MOST_WORDS} words")
    return found


def segmenter(words: list[str]):
    """A column function that segments text by a dictionary of bounded size."""
    known, longest = frozenset(words), max(map(len, words), default=1)

    @pandas_udf(ArrayType(StringType()))
    def segment(s: pd.Series) -> pd.Series:
        return s.map(lambda t: dictionary_tokens(t, known, longest) if t is not None else None)

    return segment



