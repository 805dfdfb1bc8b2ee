"""Entity discovery and linking as DataFrame transformations on Spark."""
