"""Jobs that combine operators: export planning and clip import."""
