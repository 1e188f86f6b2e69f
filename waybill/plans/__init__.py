"""The fact table and the reports over it."""
