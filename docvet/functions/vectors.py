"""Hash embeddings and vector math as built-in expressions."""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the built-in embedding.
DIMENSIONS = 64
MODEL_NAME = "local-hash-embedding-v1"
PROVIDER = "deterministic_hash"
STRATEGY_VERSION = "chunk-embedding-strategy/v0.1"

_TOKEN = re.compile("[a-z0-9]+")
#: Tokens whose features a task remembers at once, and tokens that it adds up at once.
_KNOWN_TOKENS, _TOKENS_AT_ONCE = 100_000, 100_000


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double")))


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)


def cosine(left: Column, right: Column) -> Column:
    """Cosine similarity, 0 where a norm is 0; vectors of different length are an error."""
    scale = norm(left) * norm(right)
    value = F.when(scale == 0, F.lit(0.0)).otherwise(F.try_divide(dot(left, right), scale))
    return F.when(F.size(left) == F.size(right), value).otherwise(
        F.raise_error(F.lit("embedding vectors must have the same dimensions.")).cast("double")
    )


def non_zero(vector: str) -> Column:
    """(dim, value) of a vector's numbers other than 0, chosen before they become rows."""
    places = F.transform(vector, lambda v, i: F.struct(i.alias("dim"), v.alias("value")))
    return F.filter(places, lambda p: p["value"] != 0)


def _rounded(numbers: np.ndarray) -> np.ndarray:
    """Each number rounded as Python's round(x, 6) does it."""
    scaled = numbers * 1e6
    out = np.rint(scaled) / 1e6
    for at in zip(*np.nonzero((np.abs(scaled - np.floor(scaled) - 0.5) < 1e-4) | ~(np.abs(scaled) < 1e9))):
        out[at] = round(float(numbers[at]), 6)
    return out


def hash_embedding(
    text: Column, model_name: str = MODEL_NAME, dimensions: int = DIMENSIONS, normalize: bool = True
) -> Column:
    """Vector of a text: features of its tokens are summed per bucket in token order, scaled to length 1 and rounded.

    An Arrow function, as a token's sha256 is then taken once a task and not once an occurrence. A null
    text counts as one without tokens.
    """

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def embed(texts: pd.Series) -> pd.Series:
        buckets, weights, out = [], [], []
        numbers, counts = [], []

        class Known(dict):
            def __missing__(self, token: str) -> int:
                digest = hashlib.sha256(f"{model_name}:{token}".encode()).digest()
                weight = 1.0 + digest[5] / 255
                buckets.append(int.from_bytes(digest[:4], "big") % dimensions)
                weights.append(weight if digest[4] % 2 == 0 else -weight)
                self[token] = len(weights) - 1
                return self[token]

        known = Known()

        def add_up() -> None:
            at = np.array(numbers, dtype=np.int64)
            cells = np.repeat(np.arange(len(counts)), counts) * dimensions + np.array(buckets, dtype=np.int64)[at]
            sums = np.bincount(cells, np.array(weights)[at], len(counts) * dimensions).reshape(len(counts), dimensions)
            if normalize:
                sizes = np.array([math.sqrt(sum(v * v for v in line)) or 1.0 for line in sums.tolist()])
                sums = sums / sizes[:, None]
            out.extend(_rounded(sums))
            numbers.clear()
            counts.clear()

        for value in texts:
            tokens = _TOKEN.findall((value or "").lower()) or ["empty"]
            if len(numbers) >= _TOKENS_AT_ONCE or len(known) >= _KNOWN_TOKENS:
                if counts:
                    add_up()
                if len(known) >= _KNOWN_TOKENS:
                    for held in (known, buckets, weights):
                        held.clear()
            numbers.extend([known[t] for t in tokens])
            counts.append(len(tokens))
        if counts:
            add_up()
        return pd.Series(out, dtype=object)

    return embed(text)
