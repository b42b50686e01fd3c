"""Where the four tables come from: role views, CSV ingest, stored tables."""
