"""operators of the evidence-fusion engine."""
