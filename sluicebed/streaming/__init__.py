"""The append-only feedback log as a stream."""
