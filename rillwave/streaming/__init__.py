"""Views over streams."""
