"""Token counters: a native estimate and byte-pair encodings."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

FALLBACK_ENCODING = "cl100k_base"


def estimate_tokens(text: Column) -> Column:
    """A quarter of the code points, one at least."""
    return F.greatest(F.lit(1).cast("long"), F.floor(F.length(text) / 4).cast("long"))


@lru_cache(maxsize=None)
def load_encoding(name: str):
    """The encoder for a model or encoding name, once per worker; None if no vocabulary is at hand."""
    try:
        import tiktoken
    except ImportError:
        warnings.warn("no byte-pair encoder is installed; token counts are estimates")
        return None
    try:
        try:
            return tiktoken.encoding_for_model(name)
        except KeyError:
            pass
        try:
            return tiktoken.get_encoding(name)
        except ValueError:
            warnings.warn(f"{name!r} is unknown; using {FALLBACK_ENCODING!r}")
            return tiktoken.get_encoding(FALLBACK_ENCODING)
    except Exception as error:  # the vocabulary file could not be fetched
        warnings.warn(f"no vocabulary for {name!r} ({type(error).__name__}); token counts are estimates")
        return None


def bpe_tokens(text: Column, encoding: str = FALLBACK_ENCODING, load: Callable = load_encoding) -> Column:
    """Exact token count in Arrow batches; the native estimate where no vocabulary is at hand."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        encoder = load(encoding)
        if encoder is None:
            return pd.Series([None] * len(texts), dtype="Int64")
        sizes = [None if t is None else len(encoder.encode(t, disallowed_special=())) for t in texts]
        return pd.Series(sizes, dtype="Int64")

    return F.coalesce(count(text), estimate_tokens(text))


_BACKENDS: dict[str, Callable[..., Column]] = {"heuristic": estimate_tokens, "bpe": bpe_tokens}


def register_backend(name: str, counter: Callable[..., Column]) -> None:
    """Add a token counter: a function from a text column to a long column."""
    _BACKENDS[name] = counter


def count_tokens(text: Column, backend: str = "heuristic", **options: object) -> Column:
    if backend not in _BACKENDS:
        raise ValueError(f"unknown token counter {backend!r}; known: {sorted(_BACKENDS)}")
    return _BACKENDS[backend](text, **options)
