"""Column expressions shared by the reports."""
