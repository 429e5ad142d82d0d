"""operators of actionline."""
