"""Reversible masking of sensitive values as DataFrame operators."""
