"""Plain functions from DataFrames to DataFrames; the SQL front end calls the same ones."""
