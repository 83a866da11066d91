"""The registered queries: stand-in views, Spark queries and equivalent SQL."""
