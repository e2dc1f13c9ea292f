"""The registered queries: the library run on the given tables, and the same results written as SQL."""
