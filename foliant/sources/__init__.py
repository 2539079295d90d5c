"""Sources: files and markup into rows of text."""
