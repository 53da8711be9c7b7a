"""What is planned before any data is read: search queries and SQL statements."""
