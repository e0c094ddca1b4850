"""Column and window building blocks shared by the operators."""
