"""Driver loops over the operators."""
