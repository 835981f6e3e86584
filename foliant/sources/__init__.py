"""Sources: containers, markup and packages as tables."""
