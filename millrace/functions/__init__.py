"""Column helpers shared by the transforms."""
