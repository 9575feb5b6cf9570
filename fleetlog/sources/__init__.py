"""Reading polls and keeping tables in shared storage."""
