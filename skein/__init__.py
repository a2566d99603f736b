"""A catalogue analytics engine on Spark."""
