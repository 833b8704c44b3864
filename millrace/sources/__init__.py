"""Sources of tables: files, databases, memory and custom readers."""
