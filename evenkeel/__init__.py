"""Keep Spark tables equal to what was declared."""
