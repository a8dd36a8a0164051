"""A PySpark engine for versioned, hierarchically keyed items."""
