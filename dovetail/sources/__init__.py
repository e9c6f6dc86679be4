"""Tables, file scans and stored tables."""
