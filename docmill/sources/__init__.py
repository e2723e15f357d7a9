"""Readers and writers of document stores."""
