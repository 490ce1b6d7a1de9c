"""Detection pipelines composed from the operators, and the query registry."""
