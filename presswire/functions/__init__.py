"""Column functions, content extraction and summaries."""
