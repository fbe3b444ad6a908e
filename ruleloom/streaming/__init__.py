"""Standing programs over streams of signed rows."""
