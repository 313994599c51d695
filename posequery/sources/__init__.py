"""Readers and writers for recordings, trajectories, diagnostics and run ledgers."""
