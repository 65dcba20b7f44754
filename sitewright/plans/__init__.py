"""Plans of the site screening library."""
