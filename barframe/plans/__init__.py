"""Named queries over the data tables, and the SQL that each is held against."""
