"""Column builders and batched kernels."""
