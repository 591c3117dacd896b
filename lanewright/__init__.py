"""lanewright: vehicle tracks and lane networks as Spark DataFrames."""
