"""Readers of register files and writers of snapshots."""
