"""Adapters that turn stored documents into the block table."""
