"""Named queries over the test tables and the SQL that states their expected results."""
