"""The moments of a stream, kept in bounded state."""
