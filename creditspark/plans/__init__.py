"""Whole tables built from the operators."""
