"""Column expressions and ordered-data helpers; import the modules directly."""
