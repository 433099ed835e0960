"""Named queries over a folder of Parquet tables, with the SQL each must agree with."""
