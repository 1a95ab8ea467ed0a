"""Part of labelframe; see README.md."""
