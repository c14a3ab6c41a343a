"""Named queries by family."""

from . import activities, events, extras, nights, relational, rhythm, signal_queries, signals

REGISTRIES = [rhythm.R, events.R, signals.R, nights.R, activities.R, relational.R, signal_queries.R, extras.R]
