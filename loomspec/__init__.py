"""loomspec: declarative table specifications compiled to Spark plans."""
