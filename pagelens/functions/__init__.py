"""Column functions: URLs and words. All are built-in expressions, so they stay inside whole-stage code generation."""
