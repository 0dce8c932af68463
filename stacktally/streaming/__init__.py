"""The same work on streams of landed profiles and log lines."""
