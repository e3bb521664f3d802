"""Column functions over text and geometry."""
