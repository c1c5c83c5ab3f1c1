"""Reading tables, and the tables the library keeps."""
