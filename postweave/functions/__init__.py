"""Column functions: every one takes Columns (or names) and returns a Column."""
