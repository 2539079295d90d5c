"""Registered queries."""

from foliant.plans import annotations, containers, galaxy, intelligence, output, queries, records, retrieval, store, texts  # noqa: F401  each registers its queries
