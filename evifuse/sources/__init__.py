"""sources of the evidence-fusion engine."""
