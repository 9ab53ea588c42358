"""Reading services, search results and fetched pages; writing results."""
