"""Reading and writing transcripts, listings, generations and snapshots."""
