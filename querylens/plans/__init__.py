"""Query-plan text to operator, fragment-graph and optimisation-signal tables."""
