"""streaming of actionline."""
