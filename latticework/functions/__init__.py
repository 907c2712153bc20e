"""Scalar functions: columns in, columns out, all inside Spark's own expressions."""
