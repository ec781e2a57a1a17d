"""Reading and writing: CSV files, tables and shared scratch folders."""
