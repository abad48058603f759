"""One module per family of jobs; every public function maps DataFrames to DataFrames."""
