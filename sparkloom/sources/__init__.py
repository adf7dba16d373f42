"""Where graphs come from: the text format, and tables."""
