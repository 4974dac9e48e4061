"""Usage statistics over an event log, in batch and as a stream."""
