"""Column-level building blocks: type classes, missing values, text and numbers."""
