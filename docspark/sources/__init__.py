"""Document sources: each turns files or texts into rows of elements, cells and pages."""
