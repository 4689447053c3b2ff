"""Reversible operators: each learns by aggregation, and is applied and reversed as column expressions."""
