"""Readers and writers: archives, CSV, JSON lines, manifests, exports and content-addressed artifacts."""
