"""Text output."""
