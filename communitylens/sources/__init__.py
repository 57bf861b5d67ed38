"""Reading, writing, sampling and profiling of tables."""
