"""Directory scans and format readers."""
