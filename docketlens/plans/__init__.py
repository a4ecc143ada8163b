"""Domain tables, queries over them and the SQL that checks the queries."""
