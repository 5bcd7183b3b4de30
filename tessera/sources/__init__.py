"""Readers and writers of samples, timing records, metrics and stage artifacts."""
