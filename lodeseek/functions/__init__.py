"""Column functions: no Python runs on executors."""
