"""Column-level helpers: constants, tail probabilities, draws, array statistics."""
