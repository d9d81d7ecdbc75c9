"""Column functions: each takes and gives Columns, so that Catalyst plans them within one stage."""
