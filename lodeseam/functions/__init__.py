"""Part of lodeseam; see README.md."""
