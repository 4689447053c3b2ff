"""Column functions: random numbers by key, numeric and date expressions, dictionaries, regex enumeration."""
