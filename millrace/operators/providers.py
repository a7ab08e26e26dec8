"""Embedding providers by name, the first one of a preference that is there taking the work.

A provider is (ready, embed): ready tells whether it can run here, embed gives (doc_id,
embedding) from (doc_id, text). A new provider is a new entry.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from millrace.operators.documents import hash_embeddings

Provider = tuple[Callable[[], bool], Callable[[DataFrame, int], DataFrame]]
PROVIDERS: dict[str, Provider] = {"hash": (lambda: True, hash_embeddings)}


def register(name: str, ready: Callable[[], bool], embed: Callable[[DataFrame, int], DataFrame]) -> None:
    PROVIDERS[name] = (ready, embed)


def chosen(preference: list[str]) -> str:
    """The first provider of the preference that is known and ready; hash, which always is, after all others."""
    for name in [*preference, "hash"]:
        if name in PROVIDERS and PROVIDERS[name][0]():
            return name
    raise LookupError("no provider is ready")


def embedded(docs: DataFrame, dims: int = 768, preference: list[str] | None = None) -> DataFrame:
    return PROVIDERS[chosen(preference or [])][1](docs, dims)


def limited(rows: DataFrame, wanted: int | None, most: int = 1000) -> DataFrame:
    """At most ``wanted`` rows of an ordered report, 1 to ``most``; without a wish ``most``. The limit is the feature."""
    return rows.limit(min(max(1, most if wanted is None else wanted), most))
