"""streaming of the evidence-fusion engine."""
