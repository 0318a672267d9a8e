"""Readers and writers of catalogs and their side files."""
