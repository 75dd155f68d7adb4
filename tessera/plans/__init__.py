"""Registered queries. Importing this package registers all of them."""
