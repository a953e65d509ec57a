"""Column functions: all of them compile to built-in Catalyst expressions."""
