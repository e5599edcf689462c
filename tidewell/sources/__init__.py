"""Readers and writers: corpus folders, snapshots, upserts, query sets and logs."""
