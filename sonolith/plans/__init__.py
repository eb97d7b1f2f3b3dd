"""Queries and the DuckDB SQL that says the same; `registry` holds them once these modules are imported."""

from . import audio, catalogue, relational, songs  # noqa: F401
