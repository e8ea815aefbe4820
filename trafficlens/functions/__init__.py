"""Column expressions (all built-in, codegen-friendly; no Python UDFs)."""
