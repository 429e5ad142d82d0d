"""actionline: Spark jobs for action-aligned interaction-recording datasets."""
