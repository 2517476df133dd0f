"""Column-level functions (all built-in Spark expressions, codegen-friendly)."""
