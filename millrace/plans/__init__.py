"""Views over the given tables and the queries registered on them."""
