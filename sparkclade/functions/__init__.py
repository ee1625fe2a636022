"""Part of sparkclade; see README.md."""
