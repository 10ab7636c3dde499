"""Column functions: paths, globs and text.  All are built-in Spark SQL expressions."""
