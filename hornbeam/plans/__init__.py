"""Terms, parsing and the planning of goals into DataFrames."""
