"""Plans: fused fits, the registry of operators, whole-table transformers, and measurements."""
