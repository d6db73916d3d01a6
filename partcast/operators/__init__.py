"""DataFrame -> DataFrame operators, grouped by analytical area."""
