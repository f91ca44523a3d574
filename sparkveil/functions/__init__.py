"""Column functions: normalisation, validators, span search, conflict resolution, text transformation."""
