"""eventloom: event-log discovery, validation and description on Spark DataFrames."""
