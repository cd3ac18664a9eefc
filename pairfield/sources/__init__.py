"""Where observations, cells, catalogue records and templates come from."""
