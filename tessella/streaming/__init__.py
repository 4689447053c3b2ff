"""Fitted plans on streams: a plan is a projection, so it applies to unbounded tables as it is."""
