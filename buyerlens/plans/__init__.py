"""End-to-end dataflows and the registered query catalog."""
