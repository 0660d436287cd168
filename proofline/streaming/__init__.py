"""Windows and limits over event streams."""
