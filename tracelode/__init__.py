"""Code-graph analytics on Spark: tables, operators, sources and walks over source-code graphs."""
