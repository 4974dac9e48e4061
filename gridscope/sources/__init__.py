"""Reading messy files, writing typed records, and the usage event log."""
