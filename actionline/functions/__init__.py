"""functions of actionline."""
