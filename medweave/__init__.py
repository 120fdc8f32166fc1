"""Healthcare data conversion on Spark: claims to CDM tables, eras, nested records, governed exports."""
