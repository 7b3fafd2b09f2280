"""Where files and their samples come from."""
