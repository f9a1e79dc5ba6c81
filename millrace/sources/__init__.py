"""Files, the version catalog and the experiment log."""
