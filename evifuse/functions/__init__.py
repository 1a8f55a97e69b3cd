"""functions of the evidence-fusion engine."""
