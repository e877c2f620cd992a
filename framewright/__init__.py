"""framewright: compare vectors and signal frames with references, as Spark queries."""
