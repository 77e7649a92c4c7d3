"""A deterministic embedder that needs no model: signed hashing of words into a fixed dimension."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F


def hash_embed(text: str | None, dimension: int) -> list[float]:
    """A unit vector, or zeros for a text without words."""
    v = np.zeros(dimension)
    for word in re.findall(r"\w+", (text or "").lower()):
        h = zlib.crc32(word.encode())
        v[h % dimension] += 1.0 if h & 0x80000000 else -1.0
    n = np.linalg.norm(v)
    return (v / n if n > 0 else v).astype(np.float32).tolist()


#: Embedders by name: (text, dimension) to a vector. Others can be registered.
EMBEDDERS: dict[str, Callable[[str | None, int], list[float]]] = {"hashing": hash_embed}


def register(name: str, f: Callable[[str | None, int], list[float]]) -> None:
    EMBEDDERS[name] = f


def first_that_works(names: list[str], text: str | None, dimension: int) -> list[float]:
    """A chain of providers: the first that gives a vector counts."""
    errors = []
    for n in names:
        try:
            return EMBEDDERS[n](text, dimension)
        except Exception as e:  # noqa: BLE001  a provider may fail in any way; the next one is asked
            errors.append(f"{n}: {e}")
    raise RuntimeError("no embedder works: " + "; ".join(errors))


def embed_column(text: Column, dimension: int, names: list[str] | None = None) -> Column:
    chain = {n: EMBEDDERS[n] for n in names or ["hashing"]}

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        EMBEDDERS.update(chain)
        return pd.Series([first_that_works(list(chain), t, dimension) for t in texts], dtype=object)

    return run(text)


def info(name: str, dimension: int) -> dict:
    return {"providers": sorted(EMBEDDERS), "provider": name, "dimension": dimension}
