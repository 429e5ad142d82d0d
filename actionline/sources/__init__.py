"""sources of actionline."""
