"""Column functions: label algebra, clocks, URLs, fixed values."""
