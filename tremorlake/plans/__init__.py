"""Registered queries by theme; importing the package registers all of them."""

from tremorlake.plans import aggregates, evaluation, joins, panels, registry, rolling, scalar, sources, statistics, streams, tables  # noqa: F401
