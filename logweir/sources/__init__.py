"""Reading files and event XML into DataFrames."""
