"""Named plans with the SQL they are checked against."""
