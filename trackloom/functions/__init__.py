"""Column builders: geometry, circular values, scalar helpers. All of them stay inside generated code."""
