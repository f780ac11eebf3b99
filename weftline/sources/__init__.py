"""Readers and writers of instances and of schema languages."""
