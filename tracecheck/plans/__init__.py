"""Properties: their syntax, their plan, and running them over traces."""
