"""Named queries over the library's tables and the SQL they are checked against."""
