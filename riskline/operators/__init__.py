"""DataFrame operators: cohort, events, panel, protocol, models, curves, reports."""
