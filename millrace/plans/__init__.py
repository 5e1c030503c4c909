"""End-to-end refreshes of one business domain each."""
