"""Readers and writers: clip containers, raw frame dumps, JSON documents, listings."""
