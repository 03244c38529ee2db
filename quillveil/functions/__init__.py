"""Pure functions: identifier checks, text folding, value predicates."""
