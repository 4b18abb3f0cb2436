"""Readers from files to blocks, and writers back."""
