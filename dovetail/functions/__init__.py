"""Column expressions: pure functions of columns, evaluated inside generated code."""
