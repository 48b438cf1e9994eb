"""Analytics over compiled code artifacts, text and events on Spark DataFrames."""
