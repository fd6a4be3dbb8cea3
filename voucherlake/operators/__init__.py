"""DataFrame operators; every function takes and returns DataFrames and starts no job."""
