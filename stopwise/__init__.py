"""Public-transport analytics on Spark: timetables, live feeds, journeys and search as DataFrames."""
