"""All query modules; importing them fills the registry."""

from inkfield.plans import decisions, detect, detect_sql, files, label_sets, layouts, ordered_rows, rasters, sources, streams, texts  # noqa: F401
from inkfield.plans.registry import QUERIES, SQL  # noqa: F401
