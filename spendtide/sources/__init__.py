"""Reading documents, ads and text files; writing tables and snapshots."""
