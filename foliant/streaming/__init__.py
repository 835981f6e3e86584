"""Streams: save sessions that expire, and folders that documents are dropped into."""
