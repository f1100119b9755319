"""Column expressions shared by the operators. Nothing here starts a job."""
