"""Functions over single lines. Bytes are Latin-1 text here: one character a byte, whatever the bytes mean."""
