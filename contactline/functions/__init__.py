"""Column functions: text, URLs, addresses and page parsing."""
