"""loomgraph: pattern matching and rewriting of whole relational instances on Spark."""
