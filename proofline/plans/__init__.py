"""How documents are cut into units of work, and how far the work has come."""
