"""A dictionary of frequent words and the texts written with it.

A dictionary has at most 6,399 words: one code each of the private-use characters U+E000 to
U+F8FE, so that it is small however large the texts are. Private-use characters of a text are
written after U+F8FF, which makes every text come back as it was. ``encode_column`` looks words up
in a hash table, in one pass over a text; ``encode`` is the same as a column expression, for small
dictionaries, as it searches the list of words for each one.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafold.functions.arrow import append
from stratafold.operators.transforms import top_words

_TOKEN = re.compile("[\uE000-\uF8FF]|[\x20\x09-\x0D]+|[^\x20\x09-\x0D\uE000-\uF8FF]+")
_CODE = re.compile("\uF8FF(.)|([\uE000-\uF8FE])", re.S)
CODES = 0xF8FF - 0xE000


def learn(docs: DataFrame, k: int, least: int, text_col: str = "text") -> list[str]:
    """The k most frequent words of two characters or more that occur ``least`` times."""
    if k > CODES:
        raise ValueError(f"a dictionary has at most {CODES} words")
    words = docs.select(F.regexp_replace(F.coalesce(text_col, F.lit("")), "[\uE000-\uF8FF]", " ").alias("t"))
    # a bounded report: at most k rows reach the driver
    return [r.word for r in top_words(words, k, least, "t", shortest=2).collect()]


def encode_text(text: str, codes: dict[str, str]) -> str:
    return "".join([codes.get(t) or ("\uF8FF" + t if "\uE000" <= t <= "\uF8FF" else t) for t in _TOKEN.findall(text)])


def decode_text(text: str, words: list[str]) -> str:
    return _CODE.sub(lambda m: m[1] or words[ord(m[2]) - 0xE000], text)


def encode_column(df: DataFrame, text_col: str, words: list[str], out: str) -> DataFrame:
    """df with its texts written in the dictionary's codes; null is null."""
    codes = {w: chr(0xE000 + i) for i, w in enumerate(words)}
    return append(df, [text_col], [(out, "string")], lambda t: (None if t is None else encode_text(t, codes),))


def decode_column(df: DataFrame, text_col: str, words: list[str], out: str) -> DataFrame:
    return append(df, [text_col], [(out, "string")], lambda t: (None if t is None else decode_text(t, words),))


def encode(text: Column, words: list[str]) -> Column:
    tokens = F.regexp_extract_all(text, F.lit(r"[\uE000-\uF8FF]|[\x20\x09-\x0D]+|[^\x20\x09-\x0D\uE000-\uF8FF]+"), F.lit(0))
    if not words:
        words = [""]
    codes = F.map_from_arrays(F.array(*map(F.lit, words)), F.array(*[F.lit(chr(0xE000 + i)) for i in range(len(words))]))
    return F.array_join(F.transform(tokens, lambda t: F.coalesce(codes[t], F.when(t.rlike("^[\uE000-\uF8FF]"), F.concat(F.lit("\uF8FF"), t)).otherwise(t))), "")


def decode(text: Column, words: list[str]) -> Column:
    if not words:
        words = [""]
    plain = F.map_from_arrays(F.array(*[F.lit(chr(0xE000 + i)) for i in range(len(words))]), F.array(*map(F.lit, words)))
    tokens = F.regexp_extract_all(text, F.lit("\\uF8FF.|[\\uE000-\\uF8FE]|[^\\uE000-\\uF8FF]+"), F.lit(0))
    return F.array_join(F.transform(tokens, lambda t: F.when(t.startswith("\uF8FF"), F.substring(t, 2, 1)).otherwise(F.coalesce(plain[t], t))), "")
