"""Where files, chunks and indexes come from and go to."""
