"""lamina: a tiered time-series store and query engine on PySpark."""
