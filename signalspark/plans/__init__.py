"""Registered queries; importing this package registers them."""

from . import bundles, comparison, comparisons, detection, formats, insights, models, pages, readmodels, robots, sequences, series, structure  # noqa: F401
