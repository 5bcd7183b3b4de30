"""Scalar expressions on vectors and measurements."""
