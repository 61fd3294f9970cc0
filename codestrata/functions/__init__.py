"""Scalar functions as Column expressions (JVM-side unless a docstring says otherwise)."""
