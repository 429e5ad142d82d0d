"""plans of actionline."""
