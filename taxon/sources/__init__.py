"""Readers and writers: item tables, document snapshots, lookup cache, reports."""
