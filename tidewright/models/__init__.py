"""Formula models, tests and their special functions."""
