"""Ticks to bars as streams: closed bars, forming bars, and indicators with commit and rollback."""
