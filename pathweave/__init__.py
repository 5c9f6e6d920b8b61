"""Multi-hop path queries over knowledge graphs, as Spark plans."""
