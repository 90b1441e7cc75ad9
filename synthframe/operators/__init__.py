"""Set-based operators over entity tables and run records."""
