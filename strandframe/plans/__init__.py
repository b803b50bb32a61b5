"""Queries with their SQL."""

from . import reading as reading  # adds its queries to those of `queries`
