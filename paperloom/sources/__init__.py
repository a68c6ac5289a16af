"""Readers of dumped payloads, pages, notes, event logs and of the driver's tables."""
