"""Operators: DataFrame to DataFrame transformations over documents, pages, elements, cells and chunks."""
