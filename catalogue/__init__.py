"""Every operator as a query on the driver tables, with its DuckDB twin."""
