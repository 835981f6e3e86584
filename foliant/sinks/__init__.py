"""Sinks: blocks and runs as docx, odt and hwpx packages, and as IR HTML."""
