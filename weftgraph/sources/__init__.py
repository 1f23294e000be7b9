"""Sources: graph projections of tables, files, git output, infrastructure files."""
