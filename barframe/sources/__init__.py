"""Sources: series made of plain tables, and readers of files."""
