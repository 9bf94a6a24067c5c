"""crumbline: production planning for perishables, and training-data preparation, as Spark DataFrame queries."""
