"""Column expressions: no function here needs Python on the executors."""
