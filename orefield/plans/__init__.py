"""Registered queries, by theme. Each module has QUERIES (name: function) and SQL (name: DuckDB text)."""

from . import business, corpus, feeds, further, mining, monitored, modelling, more, relational, rest, segments, streams, studies

MODULES = [relational, mining, monitored, business, corpus, modelling, streams, more, rest, studies, further, segments, feeds]
