"""Table readers, batch numbering and the JSON wire format of the stream."""
