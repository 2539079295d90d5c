"""Bounds on the parameters of searches."""

from __future__ import annotations

from dataclasses import dataclass


def _within(name: str, value: float, low: float, high: float) -> None:
    if not low <= value <= high:
        raise ValueError(f"{name} must be between {low} and {high}")


@dataclass(frozen=True)
class SearchParameters:
    query: str | None = None
    limit: int = 100
    semantic_weight: float = 0.7
    text_weight: float = 0.3

    def __post_init__(self):
        _within("limit", self.limit, 1, 10_000)
        _within("semantic_weight", self.semantic_weight, 0, 1)
        _within("text_weight", self.text_weight, 0, 1)
        if self.query is not None:
            _within("the query's length", len(self.query.strip()), 1, 1000)


@dataclass(frozen=True)
class SemanticParameters:
    query: str
    limit: int = 20
    threshold: float = 0.3

    def __post_init__(self):
        _within("the query's length", len(self.query.strip()), 1, 1000)
        _within("limit", self.limit, 1, 1000)
        _within("threshold", self.threshold, 0, 1)


def described_scope(kind: str, redact: bool = True, **options) -> dict:
    """What a scope is, for display; a path prefix shows its last part only."""
    shown = dict(options)
    if redact and shown.get("prefix"):
        shown["prefix"] = "<redacted>/" + str(shown["prefix"]).rstrip("/").rpartition("/")[2]
    return {"kind": kind, **{k: v for k, v in sorted(shown.items()) if v is not None}}
