"""Entity graphs as Spark DataFrames: load, inspect, evolve, export and flatten."""
