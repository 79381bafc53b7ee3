"""Reports written from findings frames."""
