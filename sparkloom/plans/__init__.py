"""The algorithms as vertex programs, their results, and the name registry."""
