"""Column functions: byte slices, regular expressions and globs, predicates on captures, templates."""
