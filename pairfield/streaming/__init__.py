"""Optional extension: observations that arrive as files, counted per pixel as they come."""
