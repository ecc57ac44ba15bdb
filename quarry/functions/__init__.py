"""Column-level functions: pure expressions that stay inside whole-stage codegen where Spark allows."""
