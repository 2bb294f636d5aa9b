"""Readers and writers: text trees, archives, CSV, JSON, catalogues, reports, parameter-keyed caches."""
