"""Log sources and adapters to the (ts_ns, message, tags) record."""
