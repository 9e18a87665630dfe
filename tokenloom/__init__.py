"""Text tokenization on PySpark: tokenizers compile to DataFrame plans, Arrow kernels and broadcast tables."""
