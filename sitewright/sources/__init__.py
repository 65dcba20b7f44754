"""Sources of the site screening library."""
