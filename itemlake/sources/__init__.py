"""Item views, readers and writers."""
