"""Writers: files, tables, topics."""
