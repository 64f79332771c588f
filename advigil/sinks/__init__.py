"""Writers: data sets, records, tables and run records."""
