"""Reading tables, catalogues and run logs; writing results."""
