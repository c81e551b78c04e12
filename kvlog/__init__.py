"""A PySpark engine for versioned key-value data."""
