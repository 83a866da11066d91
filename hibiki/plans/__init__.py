"""Jobs that combine several operators."""
