"""Encoding a corpus with a public tokenizer; long texts are encoded in parts and joined exactly.

A text above PART characters is cut into halves, and so on, until no part is longer; the parts are encoded apart.
Their id lists are then joined up the tree: around every join a window of tokens of both sides is encoded again and
grown until its first and its last token are those the sides had there. Byte-pair encoding is decided by adjacent
pairs, so from there outwards both sides are what encoding the whole text gives.
"""

from __future__ import annotations

import base64
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kervan.session import task_slots

#: Folder of the public vocabularies; every worker reads it from its own disk.
FOLDER, NAME = "/opt/tokenizers", "byte_bpe_50k"
#: Most characters of a part; longer texts are encoded in parts.
PART = 8_192
#: Fixed value: how the vocabulary's public pre-tokenizer splits text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LOADED: dict = {}


def encoder(folder: str = FOLDER, name: str = NAME):
    """The encoder a worker holds; it knows no special tokens, so their strings are ordinary text."""
    if (folder, name) not in _LOADED:
        import tiktoken

        with open(f"{folder}/{name}.tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[folder, name] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[folder, name]


def _tail(enc, ids: list[int], n: int) -> tuple[int, str]:
    """(k, text) of the last k >= n tokens of ids that start at a character."""
    k = min(n, len(ids))
    while True:
        raw = b"".join(map(enc.decode_single_token_bytes, ids[len(ids) - k :]))
        if k == len(ids) or raw[0] & 0xC0 != 0x80:
            return k, raw.decode("utf-8")
        k += 1


def _head(enc, ids: list[int], n: int) -> tuple[int, str]:
    k = min(n, len(ids))
    while True:
        raw = b"".join(map(enc.decode_single_token_bytes, ids[:k]))
        if k == len(ids) or enc.decode_single_token_bytes(ids[k])[0] & 0xC0 != 0x80:
            return k, raw.decode("utf-8")
        k += 1


def join(enc, left: list[int], right: list[int], window: int = 8) -> list[int]:
    """Ids of the text whose halves have the ids left and right."""
    if not left or not right:
        return [*left, *right]
    n = window
    while True:
        a, before = _tail(enc, left, n)
        b, after = _head(enc, right, n)
        mid = enc.encode_ordinary(before + after)
        kept = left[len(left) - a :]
        # two tokens on each side must come out as they were, the outer one a run of another kind than the join's
        ok_left = a == len(left) or (mid[:4] == kept[:4] and _apart(enc, kept[:4]))
        ok_right = b == len(right) or (mid[-4:] == right[b - 4 : b] and _apart(enc, right[b - 4 : b]))
        if ok_left and ok_right:
            return [*left[: len(left) - a], *mid, *right[b:]]
        n *= 2


def _apart(enc, ids: list[int]) -> bool:
    """Whether the agreeing tokens are enough to fix the split between them: four of them, not all blank."""
    return len(ids) == 4 and bool(b"".join(map(enc.decode_single_token_bytes, ids)).strip())


def tree(enc, parts: list[list[int]]) -> list[int]:
    """Ids of the whole text from those of its leaves, joined pairwise level by level."""
    while len(parts) > 1:
        parts = [join(enc, parts[i], parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0] if parts else []


def _encode_udf(folder: str, name: str):
    @F.pandas_udf("array<int>")
    def encode(texts: pd.Series) -> pd.Series:
        enc = encoder(folder, name)
        return pd.Series([np.asarray(enc.encode_ordinary(t), np.int32) if t else np.empty(0, np.int32) for t in texts], dtype=object)

    return encode


def encode_texts(df: DataFrame, key: str, text: str, folder: str = FOLDER, name: str = NAME, part: int = PART) -> DataFrame:
    """key, ids: one row per row of df; empty and null texts have an empty list. key identifies a row, or not: a
    repeated row gives its ids again, a null key is a key like others, columns of any name don't matter.

    Texts above `part` characters are halved until no part is longer; the parts are encoded apart, and neighbours are
    joined exactly, level by level of the tree, each level on as many workers as it has joins.
    """
    encode = _encode_udf(folder, name)
    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    n = F.length("_text")
    short = rows.filter(F.coalesce(n <= part, F.lit(True))).select("_key", encode("_text").alias("ids"))

    @F.pandas_udf("array<int>")
    def both(parts: pd.Series) -> pd.Series:
        enc = encoder(folder, name)
        return pd.Series([np.asarray(tree(enc, [x["ids"].tolist() for x in p]), np.int32) for p in parts], dtype=object)

    long = rows.filter(n > part).withColumns({"_row": F.monotonically_increasing_id(), "_level": F.ceil(F.log2(n / F.lit(float(part)))).cast("int")})
    longest = rows.agg(F.max(n)).first()[0] or 0
    levels = max(0, math.ceil(math.log2(longest / part))) if longest > part else 0
    if not levels:
        return short.withColumnRenamed("_key", key)
    size = F.ceil(n / F.pow(F.lit(2.0), "_level")).cast("int")  # of a part, so that there are 2 ** _level of them at most
    split = F.expr("regexp_extract_all(_text, concat('(?s).{1,', cast(_size as string), '}'), 0)")
    leaf = long.withColumn("_size", size).select("_key", "_row", F.posexplode(split).alias("_i", "_part"))
    leaf = leaf.repartition(task_slots(df.sparkSession), "_row", "_i").select("_key", "_row", "_i", encode("_part").alias("ids"))
    for _ in range(levels):  # one more level of the tree; a text that is whole already is alone in its group
        leaf = leaf.groupBy("_row", F.shiftright("_i", 1).alias("_i")).agg(F.first("_key").alias("_key"), F.array_sort(F.collect_list(F.struct(F.col("_i").alias("i"), "ids"))).alias("_two"))
        leaf = leaf.select("_key", "_row", "_i", both("_two").alias("ids"))
    return short.unionByName(leaf.select("_key", "ids")).withColumnRenamed("_key", key)
