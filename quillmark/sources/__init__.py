"""Where sheets come from and where results go."""
