"""Whole plans: index building, local and global search, the final answer."""
