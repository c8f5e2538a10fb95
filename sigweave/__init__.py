"""sigweave: structural similarity and component detection over large collections, on Spark."""
