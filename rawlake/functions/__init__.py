"""Column builders: formatting, codes, matrices and transfer curves."""
